"""Token ids in a binary, word-aligned file format (Simple-8b).

Layout. A table is range-partitioned by doc_id; each partition is a *shard*, each row of a shard a
*block* of whole documents (about ``BLOCK_IDS`` ids, one document at least), stored as Parquet rows so
that Spark's own committer makes the files appear whole or not at all. A block has ``doc_ids``, ``lengths`` (ids of
each document), ``before`` (ids in the shard ahead of it), ``words`` (little-endian 64-bit words) and ``offsets``
(little-endian 32-bit: where each run of ``RUN`` ids begins in ``words``; runs are coded on their own, so
a decoder starts at any of them).

A 64-bit word holds a selector in its low 4 bits and 60 bits of data, lowest id first. Selector 1 stands for 120
zeros; selectors 2 to 15 for as many ids as ``COUNTS`` says, with ``WIDTHS`` bits each. Selector 0 is the escape: the word that
follows is one raw id of 61 to 64 bits. The last word of a run may be padded with zeros.

Edge cases: a null or empty text is the end id alone; documents with equal doc_id come in order of a hash of their
text, null ids first; other columns may have any names; an empty table gives empty files and results. Very long texts make a block of
their own.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, materialize, pick, slices, table

TOKENIZER, END = "word_bpe_49k.json", 1
BLOCK_IDS, RUN = 1 << 18, 1024
#: Fixed values of the format: ids in a word and bits of an id, by selector (0 is the escape).
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Chunks whose ids a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Bytes of text that a worker looks at in one go.
TOGETHER = 8 << 20

_counts, _widths = np.array(COUNTS), np.array(WIDTHS)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place, the selector that takes most ids from there on, up to its run's end. ids: whole runs, zeros at the end."""
    width = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.int8)
    top = ids >> np.uint64(32)
    if top.any():
        width = np.where(top > 0, 32 + np.frexp(top.astype(np.float64))[1], width).astype(np.int8)
    # The widest of the next c ids, for growing c; what lies past a run has no width.
    most = np.zeros((len(ids) // RUN, RUN + COUNTS[1]), np.int8)
    most[:, :RUN] = width.reshape(-1, RUN)
    best, have = np.zeros((len(most), RUN), np.int8), 1
    for s in range(15, 0, -1):
        while have < COUNTS[s]:
            more = min(have, COUNTS[s] - have)
            most[:, :-more] = np.maximum(most[:, :-more], most[:, more:])
            have += more
        best = np.where(most[:, :RUN] <= WIDTHS[s], np.int8(s), best)
    return best.reshape(-1)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets of the runs) of unsigned 64-bit ids; each word takes as many ids as it can."""
    n = len(ids)
    runs = -(-n // RUN)
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    flat = np.zeros(runs * RUN + COUNTS[1], np.uint64)
    flat[:n] = ids
    best = _selectors(flat[: runs * RUN])
    place = np.arange(runs * RUN)
    step = np.minimum(_counts[best], RUN - place % RUN)
    # All runs go ahead together, a word each at a time; no word reaches beyond its run.
    marked, at = np.zeros(runs * RUN, bool), np.arange(runs) * RUN
    ends = np.minimum(at + RUN, n)
    while len(at):
        marked[at] = True
        at = at + step[at]
        on = at < ends
        at, ends = at[on], ends[on]
    at = np.flatnonzero(marked)
    sel = best[at]
    size = np.where(sel == 0, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        k = np.flatnonzero(sel == s)
        if s == 0:
            words[where[k] + 1] = flat[at[k]]
            continue
        value, end = np.full(len(k), s, np.uint64), (at[k] // RUN + 1) * RUN
        if s > 1:
            for j in range(COUNTS[s]):
                inside = at[k] + j
                value |= np.where(inside < end, flat[inside], np.uint64(0)) << np.uint64(4 + j * WIDTHS[s])
        words[where[k]] = value
    return words, where[np.searchsorted(at, np.arange(runs) * RUN)].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encoded words, all runs at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # A raw word after an escape has no selector. Chains of them are short: follow them from each escape.
    if (sel == 0).any():
        k = 0
        marks = np.flatnonzero(sel == 0).tolist()
        skip = -1
        for k in marks:
            if k != skip:
                raw[k + 1] = True
                skip = k + 1
    count = np.where(raw, 0, _counts[sel])
    ends = np.cumsum(count)
    begin = ends - count
    run = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    begin = begin - begin[offsets[run]] + run * RUN
    limit = np.minimum((run + 1) * RUN, n)
    for s in range(16):
        k = np.flatnonzero((sel == s) & ~raw)
        if s == 1 or not len(k):
            continue
        if s == 0:
            out[begin[k]] = words[k + 1]
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for j in range(COUNTS[s]):
            to = begin[k] + j
            ok = to < limit[k]
            out[to[ok]] = words[k[ok]] >> np.uint64(4 + j * WIDTHS[s]) & mask
    return out


class Remembered(dict):
    """A cache in two generations: what is asked for again outlives the older one."""

    def __init__(self, work, most: int):
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def _visible_bytes() -> dict[int, str]:
    """The letter that byte-level tokenizers show for each byte: printable Latin-1 as it is, the others from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


def _laid_out(ids: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the pieces that ``code`` names one after another, number of each one's); ids: of all pieces, ``size`` of each."""
    n = size[code]
    ends = np.cumsum(n)
    return ids[np.repeat((np.cumsum(size) - size)[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The tokenizer composes letters (NFC), turns white space into cuts that no token crosses, lower-cases, and always cuts
    between a letter and a sign other than an apostrophe. So a text's ids are those of its chunks between ASCII spaces, one after another, and
    each worker has the library encode a chunk once. Signs at a chunk's end are encoded apart only after a composed letter below
    ``LATIN`` (for which the tests try every letter and sign), and there its BPE model alone does for plain letters. A-Z are lower-cased ahead only
    where no combining mark could compose with them. A text that spells a special token is encoded in one piece.
    """

    SIGNS = b".,!?;:|#$%&*"
    ASCII_SIGNS = SIGNS.decode()
    LATIN = "\u0250"
    #: First bytes of U+0300 to U+036F, the marks that compose with ASCII letters.
    MARKS = (b"\xcc", b"\xcd")

    def __init__(self, name: str = TOKENIZER):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.tokenize = self.library.model.tokenize
        #: Only the tokenizer that these cuts are known to hold for is taken apart.
        self.cuts = os.path.basename(name) == TOKENIZER
        self.shown = _visible_bytes()
        self.chunks = Remembered(self._chunk, REMEMBERED)

    def _part(self, text: str) -> bytes:
        low = text.lower()
        if max(text) < self.LATIN and text.isalpha() and low.isalpha():
            ids = [t.id for t in self.tokenize(low.encode().decode("latin-1").translate(self.shown))]
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return array("I", [t.id for t in self.tokenize(chunk.lower())]).tobytes()
        start = chunk.rstrip(self.ASCII_SIGNS)
        if start and len(start) < len(chunk) and (last := start[-1]) < self.LATIN and last.isalpha() and last.lower().isalpha():
            return self.chunks[start] + self.chunks[chunk[len(start) :]]
        return self._part(chunk)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encoded(self, text: str) -> bytes:
        """The ids of a text that spells a special token or has combining marks, as little-endian 32-bit integers."""
        if "<|" in text or not self.cuts:
            return self.whole(text).tobytes()
        return b"".join(self.chunks[part.decode()] for part in text.encode("utf-8", "replace").split())

    def _pieces(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks one after another, number of each one's). A plain word is looked up once, whatever signs it ends in."""
        stem = pc.ascii_rtrim(chunks, self.ASCII_SIGNS)
        plain = pc.ascii_is_alpha(stem)
        parts = [pc.if_else(plain, stem, chunks).dictionary_encode(), pc.if_else(plain, pc.ascii_ltrim(chunks, LOWER), "").dictionary_encode()]
        # By way of NumPy, Arrow makes Python texts at a fraction of the time.
        words, signs = (part.dictionary.to_numpy(zero_copy_only=False).tolist() for part in parts)
        found = [self.chunks[c] if c else b"" for c in words + signs]
        code = np.empty(2 * len(chunks), np.int64)
        code[::2], code[1::2] = parts[0].indices, parts[1].indices.to_numpy(zero_copy_only=False) + len(words)
        ids, n = _laid_out(np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4, code)
        return ids, n[::2] + n[1::2]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each text's). A chunk is looked up once for each batch."""
        raw = texts.fill_null("").cast(pa.binary())
        odd = np.full(len(raw), not self.cuts)
        inside = b"".join(raw.to_numpy(zero_copy_only=False))
        for part in (b"<|", *self.MARKS):
            if part in inside:
                odd |= pc.match_substring(raw, part).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts.fill_null(""))
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        found = split.flatten().dictionary_encode()
        code, first = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(split.offsets)
        first = (first - first[0]).astype(np.int64)
        ids, size = self._pieces(found.dictionary)
        whole = np.flatnonzero(odd).tolist()
        if whole:  # the one chunk of each, the empty string, gives way to the whole text
            code[first[whole]] = len(size) + np.arange(len(whole))
            others = [np.frombuffer(self.encoded(texts[k].as_py()), "<u4") for k in whole]
            ids, size = np.concatenate((ids, *others)), np.concatenate((size, [len(x) for x in others]))
        ids, n = _laid_out(ids, size, code)
        return ids, np.diff(np.concatenate(([0], np.cumsum(n)))[first])


_encoders: dict[str, Encoder] = {}

FILE = "shard int, before long, doc_ids array<{kind}>, lengths array<int>, words binary, offsets binary, n_ids long"


def together(batches, most: int):
    """Joins small batches until they hold ``most`` bytes; leaves out empty ones."""
    held: list = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _writer(name: str, end: int, kind: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        encoder = _encoders.get(name) or _encoders.setdefault(name, Encoder(name))
        shard, before, last = TaskContext.get().partitionId(), 0, end.to_bytes(4, "little")
        ids: list[np.ndarray] = []
        docs: list = []
        sizes: list[np.ndarray] = []
        held = 0

        def block():
            nonlocal before, held
            flat = np.concatenate(ids).astype(np.uint64)
            words, offsets = encode(flat)
            out = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())),
                pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([offsets.astype("<u4").tobytes()], pa.binary()), pa.array([len(flat)], pa.int64()),
            ], names=["shard", "before", "doc_ids", "lengths", "words", "offsets", "n_ids"])
            before += len(flat)
            ids.clear(), docs.clear(), sizes.clear()
            held = 0
            return out

        for batch in together(slices(batches), TOGETHER):
            flat, size = encoder.batch(batch.column(1))
            flat, size = np.insert(flat, np.cumsum(size), end), size + 1
            at, names, ends = 0, batch.column(0).to_pylist(), np.cumsum(size)
            while at < len(names):
                # As many documents as the block has room for; one at least in an empty block.
                begin = int(ends[at] - size[at])
                upto = int(np.searchsorted(ends, begin + BLOCK_IDS - held, side="right"))
                if upto == at and held:
                    yield block()
                    continue
                upto = max(upto, at + 1)
                ids.append(flat[begin : ends[upto - 1]]), sizes.append(size[at:upto]), docs.extend(names[at:upto])
                held += int(ends[upto - 1]) - begin
                at = upto
        if held:
            yield block()

    return run


def write_ids(documents: DataFrame, name: str = TOKENIZER, end: int = END) -> DataFrame:
    """Writes the files to the shared folder, in ascending doc_id order; returns their rows, read back."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = pick(documents, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType
    ranged = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    blocks = ranged.mapInArrow(_writer(name, end, to_arrow_type(kind)), FILE.format(kind=kind.simpleString()))
    return materialize(blocks, "token-ids", 256)


def _reader(batches):
    for batch in batches:
        shard_start, before, doc_ids, lengths, words, offsets, n_ids = (batch.column(k) for k in range(7))
        for k in range(batch.num_rows):
            n = n_ids[k].as_py()
            ids = decode(np.frombuffer(words[k].as_py(), "<u8"), np.frombuffer(offsets[k].as_py(), "<u4"), n).astype("<u4")
            sizes = np.array(lengths[k].as_py(), np.int64)
            ends = np.cumsum(sizes)
            first = shard_start[k].as_py() + before[k].as_py()
            crc = [zlib.crc32(ids[b - s : b].tobytes()) for b, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids[k].values, pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(files: DataFrame) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids_crc32."""
    # One row for each shard: as many as there were partitions.
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_start"))
    # One row a shard, two numbers each, however many documents there are: the encoded words themselves need no shuffle.
    rows = files.join(F.broadcast(starts), F.col("shard") == F.col("s")).select("shard_start", "before", "doc_ids", "lengths", "words", "offsets", "n_ids")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(_one_by_one, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _one_by_one(batches):
    for batch in slices(batches, 1):
        yield from _reader([batch])


def op1_token_ids(spark, sf_dir):
    return read_index(write_ids(table(spark, sf_dir, "documents")))
