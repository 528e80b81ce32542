"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Copies with one fingerprint are folded first, so the search works on
distinct fingerprints. The 64 bits fall into three bands (22, 21 and 21 bits). Two fingerprints
that differ in at most 4 bits differ in at most one bit of some band. In each band the anchors are
the words of the perfect binary Golay code [23, 12] (shorter bands padded with zeros), a covering
code of radius 3: every fingerprint has exactly one *home* anchor within 3 bits, and whatever
differs from it by one bit lies within 3 + 1 bits of that anchor. So each fingerprint is
replicated to every anchor within 4 bits (5.3 on average), and each anchor compares its home rows with
the rows that reach it: no linked pair can be missed. (Wider thresholds up to 11 bits reach anchors within 3 + 11 // 3 bits.)

Hot anchors: the rows of an anchor with more than ``CHUNK`` home rows are divided
again by exact pieces of the bits outside the band, one more than the threshold (so that one piece is
equal in any linked pair), which finds the same links; an anchor's share of the comparisons then falls by the pieces' 512 values. Home rows that are still
together go to chunks of about ``CHUNK``, chosen by a hash, and the rows that reach them are sent to each chunk, so no task has to hold a hot group. A chunk
returns links that connect what it finds (a forest), never all pairs. Components are then found by
alternating large-star and small-star rounds, each written to the shared folder.

The pipeline's stage (``first_of_each``) looks for texts whose sets of five-word shingles are 0.8 alike, for which one fingerprint is
too coarse. So it covers several independent fingerprints of each text by the same anchors, compares what meets at an anchor
by more bits, and tests what these candidates connect on whole shingle sets.

Edge cases: null, empty and blank texts have fingerprint zero and link to each other like any other;
texts with fewer than four words have one shingle; repeated rows and ties give a row each with the
same component; other columns may have any names; texts are taken whole; an empty table gives an empty result. A null doc_id is a document whose own id can't
be a component's smallest unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard
from .common import materialize, over_texts, pick, slices, table

SHINGLE, SEED, NEAR = 4, 42, 4
#: Low bits of each band and its width.
BANDS = ((0, 22), (22, 21), (43, 21))
CHUNK = 4096
#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    if not text:
        return np.zeros(0, np.uint64)
    # bytes.lower and bytes.split know ASCII only: A-Z, and the six ASCII spaces.
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if len(parts) <= width:
        return np.array([xxh64_intdigest(b" ".join(parts), SEED)] if parts else [], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = np.concatenate(([0], ends[: len(parts) - width] + 1)).tolist()
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit integer (bit 63 is the sign)."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):  # long texts in parts: 64 bytes for each shingle
        bits = np.unpackbits(h[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def _anchor_tables(extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaders, flips): for each 11-bit syndrome the coset leader, and its error words within 3 + ``extra`` bits."""
    def syndrome(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    basis = np.array([syndrome(1 << k) for k in range(23)], np.int64)
    from itertools import combinations

    leader = np.zeros(2048, np.int64)
    within: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(4 + extra):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= int(basis[b])
            error = sum(1 << b for b in bits)
            if weight <= 3:
                leader[s] = error
            within[s].append(error)
    width = max(map(len, within))
    flips = np.full((2048, width), -1, np.int64)
    for s, errors in enumerate(within):
        flips[s, : len(errors)] = errors
    return leader, flips


_tables: dict[int, tuple] = {}


def anchors(values: np.ndarray, extra: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of up to 23 bits: home anchor; and (row, anchor) of all anchors within 3 + ``extra`` bits."""
    if extra not in _tables:
        _tables[extra] = _anchor_tables(extra)
    leader, flips = _tables[extra]
    s = values.astype(np.int64).copy()
    for k in range(22, 10, -1):
        s ^= np.where(s >> k & 1, GOLAY << (k - 11), 0)
    home = values ^ leader[s]
    errors = flips[s]
    row, col = np.nonzero(errors >= 0)
    return home, row, values[row] ^ errors[row, col]


def _reached(u: np.ndarray, extra: int):
    """For each band of unsigned fingerprints: its number, the home anchors, and (row, anchor) of all anchors that a row reaches."""
    for b, (low, width) in enumerate(BANDS):
        band = (u >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        yield b, *anchors(band, extra)


def _replicas(extra: int, homes_only: bool = False):
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fp):
                continue
            for b, home, row, anchor in _reached(fp.view(np.uint64), extra):
                if homes_only:
                    row, anchor = row[:0], anchor[:0]
                key = np.concatenate((home, anchor)) * len(BANDS) + b
                side = np.concatenate((np.zeros(len(fp), np.int8), np.ones(len(row), np.int8)))
                which = np.concatenate((np.arange(len(fp)), row))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(fp[which])], names=["key", "side", "fp"])

    return run


def pieces(fp, band, count: int):
    """An array of ``count`` pieces of the bits of a fingerprint outside a band, each with its place."""
    def outside(low: int, width: int):
        above = F.shiftleft(F.shiftrightunsigned(fp, low + width), low) if low + width < 64 else F.lit(0).cast("long")
        return fp.bitwiseAND(F.lit((1 << low) - 1).cast("long")).bitwiseOR(above)

    size = -(-(64 - min(w for _, w in BANDS)) // count)
    rest = F.when(band == 0, outside(*BANDS[0])).when(band == 1, outside(*BANDS[1])).otherwise(outside(*BANDS[2]))
    return F.array(*[F.struct(F.lit(p).alias("p"), F.shiftrightunsigned(rest, p * size).bitwiseAND(F.lit((1 << size) - 1).cast("long")).alias("bits")) for p in range(count)])


def _join_up(home: np.ndarray, label: np.ndarray, other: np.ndarray, near: int, src: list, dst: list) -> None:
    """Links of some rows with the home rows: each row's nearest one, and one more for each group of home rows that it joins up."""
    d = np.bitwise_count(other[:, None] ^ home[None, :])
    # A pair within reach meets at either one's home, so the smaller one's is enough; this leaves out a row itself, too.
    d[home[None, :] >= other[:, None]] = 255
    for j in np.flatnonzero((d <= near).any(1)).tolist():
        hit = np.flatnonzero(d[j] <= near)
        nearest = hit[d[j, hit].argmin()]
        src.append(home[nearest]), dst.append(other[j])
        others, at = np.unique(label[hit], return_index=True)
        foreign = others != label[nearest]
        if foreign.any():
            src.extend(home[hit[at[foreign]]]), dst.extend([other[j]] * int(foreign.sum()))
            label[np.isin(label, others)] = label[nearest]


def _compare(near: int):
    """Rows sorted by (key, chunk, side): home rows of a chunk are held, the others stream by in parts."""
    def run(batches):
        at, parts, home, label = None, [], None, None
        for batch in batches:
            key, chunk, side, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(key):
                continue
            u = fp.astype(np.int64).view(np.uint64)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1])) + 1
            src: list = []
            dst: list = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                if (now := (int(key[a]), int(chunk[a]))) != at:
                    at, parts, home = now, [], None
                if side[a] == 0:
                    parts.append(u[a:b])
                    continue
                if not parts:
                    continue
                if home is None:
                    home = np.unique(np.concatenate(parts))
                    label = np.arange(len(home))
                step = max(1, 2_000_000 // len(home))
                for k in range(a, b, step):
                    _join_up(home, label, u[k : min(b, k + step)], near, src, dst)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)], names=["a", "b"])

    return run


def links(distinct: DataFrame, near: int = NEAR) -> DataFrame:
    """From distinct fingerprints (column fp): links (a, b) with the components of all pairs within ``near`` bits (12 less one at most)."""
    extra = near // len(BANDS)
    if extra > 3:
        raise ValueError("at most 11 differing bits")
    shape = "key long, side byte, fp long"
    homes = distinct.select("fp").mapInArrow(_replicas(extra, True), shape)
    # Anchors are at most the words of the code in each band, 12,288: that bounds what is broadcast.
    hot = materialize(homes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(F.col("key").alias("hot")), "simhash-hot")

    def placed(rows: DataFrame) -> DataFrame:
        """Rows by anchor, those of hot anchors by anchor and piece."""
        rows = rows.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
        whole = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("bits")))
        parts = F.when(F.col("hot").isNull(), whole).otherwise(pieces(F.col("fp"), F.col("key") % len(BANDS), near + 1))
        return rows.select("key", "side", "fp", F.explode(parts).alias("x")).select(F.xxhash64("key", "x.p", "x.bits").alias("key"), "side", "fp")

    crowds = placed(homes).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    chunks = crowds.select(F.col("key").alias("k"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = placed(distinct.select("fp").mapInArrow(_replicas(extra), shape)).join(chunks, F.col("key") == F.col("k"), "left").drop("k").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.when(F.col("side") == 0, own).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    rows = rows.select("key", "chunk", "side", "fp").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "side")
    return rows.mapInArrow(_compare(near), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each component that has an edge, by alternating large-star and small-star rounds."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        # Rows (a, b): b a neighbour of a; only the minimum of the neighbours is gathered, pre-aggregated.
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    down = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = materialize(down, "cc")
    check = None
    while True:
        before, half = down, materialize(star(down, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc")
        down = materialize(star(half, False), "cc")
        discard(before), discard(half)
        now = down.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == check:
            break
        check = now
    return down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def printed(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, h (hash of the text), fp (signed fingerprint), written; one row for each row of documents."""
    def prints(batches):
        for batch in slices(batches):
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "h", "fp"])

    docs = pick(documents, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.mapInArrow(prints, f"doc_id {kind}, h long, fp long"), "simhash-prints", 256)


def near_duplicates(documents: DataFrame, width: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """doc_id, fp, component_id; one row for each row of documents."""
    rows = printed(documents, width)
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = materialize(links(distinct, near), "simhash-links")
    groups = materialize(components(found), "simhash-groups")
    member = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = member.join(named, "root").select(F.col("fp").alias("f"), "component_id")
    return rows.join(placed, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For whole-text near-duplicates: five-word shingles, kept if the shingle sets are 0.8 alike.
FILTER_WIDTH, ALIKE = 5, 0.8
#: Independent fingerprints of a text, and the bits that one of their bands may differ in beyond an anchor's radius.
PRINTS, EXTRA = 7, 1
#: Texts that meet at an anchor are candidates if their first ``SKETCH`` fingerprints differ in at most ``FAR`` bits, of 192. Pairs that
#: are 0.8 alike differ in 29 on average, with a deviation of 5; unrelated ones in 96, with a deviation of 7.
SKETCH, FAR = 3, 56
#: Most shingles of the home rows of one chunk.
CHUNK_SHINGLES = 4_000_000
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PRINTS), np.uint64) << np.uint64(1) | np.uint64(1)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(h: np.ndarray) -> np.ndarray:
    """``PRINTS`` independent SimHashes of a set of shingle hashes: of each hash, multiplied and mixed anew for each. An empty set has zeros."""
    counts = np.zeros(64 * PRINTS, np.int64)
    for k in range(0, len(h), 255):  # so many sums fit a byte
        x = h[k : k + 255, None] * _ODD[0] + _ODD[1]
        x = (x ^ x >> np.uint64(32)) * _ODD[1]
        x ^= x >> np.uint64(29)
        counts += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8")


def _visits(homes_only: bool = False):
    """From (id, words): a row for each anchor of each fingerprint, at home (side 0) or in reach of it (1), with the sketch to compare."""
    def run(batches):
        for batch in slices(batches, 1024):
            name = batch.column(0).to_numpy(zero_copy_only=False)
            words = np.array([np.frombuffer(w.as_py(), "<u8") for w in batch.column(1)], np.uint64).reshape(-1, PRINTS)
            for p in range(PRINTS if len(name) else 0):
                for b, home, row, anchor in _reached(words[:, p], EXTRA):
                    base = p * len(BANDS) + b
                    if homes_only:
                        yield pa.RecordBatch.from_arrays([pa.array(home * (len(BANDS) * PRINTS) + base)], names=["key"])
                        continue
                    key = np.concatenate((home, anchor)) * (len(BANDS) * PRINTS) + base
                    side = np.concatenate((np.zeros(len(name), np.int8), np.ones(len(row), np.int8)))
                    which = np.concatenate((np.arange(len(name)), row))
                    sketch = [pa.array(words[which, s].view(np.int64)) for s in range(SKETCH)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(name[which]), *sketch], names=["key", "side", "id", *SKETCH_NAMES])

    return run


SKETCH_NAMES = [f"s{k}" for k in range(SKETCH)]


def _meet(home: np.ndarray, label: np.ndarray, names: np.ndarray, other: np.ndarray, other_names: np.ndarray, src: list, dst: list) -> None:
    """Links of some rows with the home rows: one for each row that is near any, and one more for each group of home rows that it joins up."""
    d = np.zeros((len(other), len(home)), np.uint16)
    for s in range(SKETCH):
        d += np.bitwise_count(other[:, s, None] ^ home[None, :, s])
    near = (d <= FAR) & (other_names[:, None] != names[None, :])
    hits = np.flatnonzero(near.any(1))
    if not len(hits):
        return
    near = near[hits]
    src.append(names[near.argmax(1)]), dst.append(other_names[hits])
    for j in np.flatnonzero(np.where(near, label, len(home)).min(1) != np.where(near, label, -1).max(1)).tolist():
        groups, at = np.unique(label[near[j]], return_index=True)
        if len(groups) > 1:
            src.append(names[np.flatnonzero(near[j])[at]]), dst.append(np.full(len(at), other_names[hits[j]]))
            label[np.isin(label, groups)] = groups[0]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components in as few links as can be: each name with the smallest one of its component."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(a := a[(apart := label[a] != label[b])]):
        b = b[apart]
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least), np.minimum.at(label, label[b], least)
        while ((up := label[label]) != label).any():
            label = up
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


#: Links that a task gathers before it reduces them, and sends what is left if that is over half.
GATHER = 400_000


def _candidates(batches):
    """Rows sorted by place (an anchor's chunk, then the side): home rows are held, the others stream by in parts.

    A task reduces the links of all its anchors, or a text with many near copies would be linked with others of them at each anchor.
    """
    at, held, home, label, names = None, [], None, None, None
    src: list = []
    dst: list = []

    def gathered():
        pair = _stars(np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64),) * 2
        src[:], dst[:] = [pair[0]], [pair[1]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])

    for batch in batches:
        place, name, *sketch = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2 + SKETCH))
        if not len(place):
            continue
        words = np.stack(sketch, 1).view(np.uint64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
            if (now := int(place[a]) >> 1) != at:
                at, held, home = now, [], None
            if not place[a] & 1:
                held.append((words[a:b], name[a:b]))
                continue
            if not held:
                continue
            if home is None:
                home, names = np.concatenate([w for w, _ in held]), np.concatenate([n for _, n in held])
                label = np.arange(len(home))
            step = max(1, 2_000_000 // len(home))
            for k in range(a, b, step):
                _meet(home, label, names, words[k : min(b, k + step)], name[k : min(b, k + step)], src, dst)
        if sum(map(len, src)) > GATHER and (out := gathered()).num_rows > GATHER // 2:
            yield out
            src.clear(), dst.clear()
    yield gathered()


def candidate_links(distinct: DataFrame) -> DataFrame:
    """From distinct sets of fingerprints (id, words): links (a, b) that connect all candidates.

    Two texts meet for certain where a band differs by ``EXTRA`` bits at most, so where any of their fingerprints differ by 5 at most; farther ones meet where a
    home anchor of one is in reach of the other, which of pairs that are just 0.8 alike 82 % do in one fingerprint (README has the losses in seven).
    """
    crowd = 8 * CHUNK
    homes = distinct.select("id", "words").mapInArrow(_visits(True), "key long")
    # Anchors are at most the words of the code in each band, 86,016 in all: that bounds what is broadcast.
    hot = materialize(homes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(F.col("key").alias("hot"), F.ceil(F.col("n") / crowd).cast("int").alias("chunks")), "dedup-hot")
    shape = "key long, side byte, id long, " + ", ".join(f"{s} long" for s in SKETCH_NAMES)
    rows = distinct.select("id", "words").mapInArrow(_visits(), shape).join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    own = F.array(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    chunk = F.when(F.col("hot").isNull(), F.array(F.lit(0))).when(F.col("side") == 0, own).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("chunk", F.explode(chunk))
    # One number for anchor, chunk and side keeps the many rows short.
    place = F.shiftleft(F.shiftleft("key", 20) + F.col("chunk"), 1) + F.col("side")
    rows = rows.select(place.alias("place"), "id", *SKETCH_NAMES)
    rows = rows.repartition(F.shiftright("place", 1)).sortWithinPartitions("place")
    return rows.mapInArrow(_candidates, "a long, b long")


def _bitmaps(sets: list[np.ndarray]):
    """Parts of a matrix of bits, a row for each set and a column for each hash that occurs in two sets or more."""
    _, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    width = max(64, 200_000_000 // len(sets) // 64 * 64)
    for low in range(0, int((n > 1).sum()), width):
        inside = (column >= low) & (column < low + width)
        at = column[inside] - low
        bits = np.zeros((len(sets), int(at.max()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row[inside], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        yield bits


def _link_alike(home: list, label: np.ndarray, names: np.ndarray, others: list | None, other_names: np.ndarray, least: float, src: list, dst: list) -> None:
    """Tests every pair of home rows (``others`` None), or of a home row with a smaller other one; only pairs ``least`` alike link and merge labels."""
    m = len(home)
    parts = list(_bitmaps(home + (others or [])))
    size = np.array([len(s) for s in home + (others or [])])
    first, rows = (0, m) if others is None else (m, len(others))
    width = sum(p.shape[1] for p in parts) or 1
    step = max(1, 4_000_000 // (m * width))
    for a in range(first, first + rows, step):
        b = min(a + step, first + rows)
        both = np.zeros((b - a, m), np.int64)
        for p in parts:
            each = max(1, 4_000_000 // (m * (b - a)))
            for w in range(0, p.shape[1], each):
                both += np.bitwise_count(p[a:b, None, w : w + each] & p[None, :m, w : w + each]).sum(2, dtype=np.int64)
        union = size[a:b, None] + size[None, :m] - both
        near = np.where(union > 0, both / np.maximum(union, 1), 1.0) >= least
        near &= names[None, :] > other_names[a - first : b - first, None]
        for j in np.flatnonzero(near.any(1)).tolist():
            hit = np.flatnonzero(near[j])
            groups, at = np.unique(label[hit], return_index=True)
            mine = a + j if others is None else -1
            if mine >= 0:
                at, groups = at[groups != label[mine]], np.union1d(groups, label[mine])
            src.extend(names[hit[at]].tolist()), dst.extend([int(other_names[a - first + j])] * len(at))
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]


def _verify(least: float):
    """Rows sorted by (key, chunk, side): home rows of a chunk are held, the others stream by in parts; gives a forest of verified links."""
    def run(batches):
        at, held, label, names, home = None, [], None, None, []
        src: list = []
        dst: list = []

        def close():
            nonlocal label, names, home
            if label is None and held:
                home, names = [s for _, s in held], np.array([h for h, _ in held])
                label = np.arange(len(home))
                if len(home) > 1:
                    _link_alike(home, label, names, None, names, least, src, dst)

        def stream(part):
            if part and home:
                _link_alike(home, label, names, [s for _, s in part], np.array([h for h, _ in part]), least, src, dst)

        part: list = []
        weight = 0
        for batch in slices(batches, 64):
            keys, chunks, sides, hs = (batch.column(k).to_pylist() for k in range(4))
            for key, chunk, side, h, s in zip(keys, chunks, sides, hs, batch.column(4), strict=True):
                if (key, chunk) != at:
                    close(), stream(part)
                    at, held, label, names, home, part, weight = (key, chunk), [], None, None, [], [], 0
                found = np.frombuffer(s.as_py(), np.uint64)
                if side == 0:
                    held.append((h, found))
                    continue
                close()
                part.append((h, found))
                weight += len(found)
                if len(part) >= CHUNK or weight > CHUNK_SHINGLES:
                    stream(part)
                    part, weight = [], 0
            if len(src) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst)], names=["a", "b"])
                src.clear(), dst.clear()
        close(), stream(part)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst)], names=["a", "b"])

    return run


def verified_links(documents: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): a node is a distinct text, named by its hash h, with its smallest doc_id; links join texts that are ``least`` alike.

    Texts that candidate links connect are a group. In each group all pairs are tested on their whole shingle sets, and what is returned
    connects those that pass (a forest of true links), so no pair is left out because of one that fails. A group over ``CHUNK`` texts or
    ``CHUNK_SHINGLES`` goes to several chunks, as in ``links``.
    """
    docs = pick(documents, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def printed_sets(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            words = pa.array([fingerprints(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), words, pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "h", "words", "size"])

    # What tasks over texts or anchors find is shuffled before it is written: a file of each such task would have its executor start some processes (chmod).
    prints = docs.mapInArrow(printed_sets, f"doc_id {kind}, h long, words binary, size long")
    nodes = prints.groupBy("h").agg(F.min("doc_id").alias("first"), F.first("words").alias("words"), F.first("size").alias("size"))
    nodes = materialize(nodes.withColumn("id", F.xxhash64("words")), "dedup-nodes", 256)
    distinct = materialize(nodes.groupBy("id").agg(F.first("words").alias("words")), "dedup-distinct")
    below = components(candidate_links(distinct))
    discard(distinct)
    texts_of = nodes.join(below, F.col("id") == F.col("node"), "left").select("h", "size", F.coalesce("root", "id").alias("key"))
    groups = texts_of.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("s")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("s") / CHUNK_SHINGLES, F.lit(1))).cast("int")
    rows = materialize(texts_of.join(groups.select(F.col("key").alias("g"), chunks.alias("chunks")), F.col("key") == F.col("g")).select("key", "h", "chunks"), "dedup-groups")
    needed = rows.select("h").distinct().join(nodes.select("h", "first"), "h").select(F.col("h").alias("nh"), "first")
    shingles = over_texts("binary", lambda texts: pa.array([np.unique(shingle_hashes(t, width)).tobytes() for t in texts], pa.binary()), 64)

    texts = docs.join(needed, (F.col("h") == F.col("nh")) & F.col("doc_id").eqNullSafe(F.col("first"))).dropDuplicates(["nh"])
    sets = materialize(texts.select("nh", shingles("text").alias("set")), "dedup-sets", 64)
    own = F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int")
    placed = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("key", "chunk", F.when(F.col("chunk") == own, 0).otherwise(1).cast("byte").alias("side"), "h")
    placed = placed.join(sets, F.col("h") == F.col("nh")).select("key", "chunk", "side", "h", "set")
    placed = placed.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "side")
    return nodes, materialize(placed.mapInArrow(_verify(least), "a long, b long").distinct(), "dedup-verified", 64)


def first_of_each(documents: DataFrame, width: int = FILTER_WIDTH, least: float = ALIKE) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id (of repeated rows, one). Others keep their columns and order.

    Groups are the components of verified links, so what is like nothing else always stays.
    """
    from pyspark.sql import Window as W

    nodes, found = verified_links(documents, width, least)
    below = components(found)
    groups = materialize(below.unionByName(below.select(F.col("root").alias("node"), "root").distinct()), "dedup-components")
    alone = nodes.join(groups, F.col("h") == F.col("node"), "left_anti").select(F.col("first").alias("__d"), F.col("h").alias("__h"))
    best = nodes.join(groups, F.col("h") == F.col("node")).groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "h")).alias("m"))
    keep = alone.unionByName(best.select(F.col("m.first").alias("__d"), F.col("m.h").alias("__h")))
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    doc = f"c{names.index('doc_id')}"
    plain = plain.withColumn("__t", F.xxhash64(f"c{names.index('text')}"))
    kept = plain.join(keep, F.col(doc).eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")), "left_semi")
    kept = kept.withColumn("__n", F.row_number().over(W.partitionBy(doc, "__t").orderBy(F.lit(1))))
    return kept.where("__n = 1").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
