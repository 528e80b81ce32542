"""Language-model scores from an Elias-Fano n-gram trie.

Interpolated absolute discounting over words, bigrams and trigrams of all training texts; a bigram or trigram is kept if it occurs ``LEAST``
times or more, and what is left out counts for the lower order, so the probabilities after any context sum to one:
p(w) = (c(w) - d) / N, p(w|v) = f2 + g2(v) p(w) and p(w|u,v) = f3 + g3(u,v) p(w|v), where f is (count - ``DISCOUNT``) over the context's count (0 if not
kept) and g one less the sum of f. What unknown words get is the discounted mass of the words.

The model grows with the corpus and lies in *shards*: all n-grams after a context word v are in the shard of v (a word with more than ``HOT`` occurrences has
several shards: its bigrams by the word after, its trigrams by the word before). A shard is a trie in four monotone, Elias-Fano coded
sequences (low bits packed, high bits unary, with a rank directory for select): its words, successors of v, predecessors of v, and
successors of (u, v), each with pointers from contexts to ranges; f and g are quantised to 12 bits. A query finds a context's range by two pointers and
makes a successor search relative to the context's base inside it; all is vectorised. Levels are flat buffers that are used in place, from the rows
of the model's table or from a memory-mapped file (``Trie.map``).

Flow. Documents are cut into *blocks* of about ``BLOCK`` tokens with local word numbers. Blocks and shards then talk twice, in packed rows:
a block sends each shard its words with their counts and learns their numbers and counts in the corpus; then its distinct trigrams with their counts,
and learns f and g. A shard sums what all blocks sent, ``GATHER`` rows at once, builds its part of the model and answers by querying it. So no token is
shuffled on its own, a hot word costs an entry for each block, and a task holds a block or a shard. Each block then scores its documents by itself.

Edge cases: a null, empty or blank text has only its end token; without training documents every probability is 1 (score 0);
repeated rows each get a row; a very long text makes a block of its own; columns beside those named may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, remainder, slices, table

#: Tokens of a block, tokens and words of the corpus for each shard, occurrences from which a word has several shards.
BLOCK, SHARD, WORDS, HOT = 1 << 19, 1_000_000, 4_000_000, 500_000
#: Counts from which bigrams and trigrams are kept, and what is taken off them.
LEAST, DISCOUNT = 2, 0.75
LOWEST = -16.0  # log10 that the codes reach
#: Rows of grams that a shard makes distinct at once, grams that it looks up at once, highest value that is ranked by marks.
GATHER, LOOK, MARKS = 2_000_000, 1 << 17, 1 << 24
LEVELS = 4095  # codes of values; the last one more is that of what is not kept
NONE = LEVELS


# --- Elias-Fano sequences -------------------------------------------------------------------------------------------

_BYTE_COUNT = np.array([bin(x).count("1") for x in range(256)], np.int64)
_BYTE_SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    for _r, _k in enumerate([k for k in range(8) if _b >> k & 1]):
        _BYTE_SELECT[_b, _r] = _k


class EliasFano:
    """A monotone sequence; ``access`` and ``successor`` take arrays of queries."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks
        self.zeros = 8 * np.arange(len(ranks)) - ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            at = np.arange(n) * bits
            part = (values & ((1 << bits) - 1)).astype(np.uint64)
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros((int(ones[-1]) // 8 + 1) if n else 1, np.uint8)
        np.bitwise_or.at(unary, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        ranks = np.concatenate(([0], np.cumsum(_BYTE_COUNT[unary])))
        return cls(n, bits, low, unary, ranks.astype(np.int32))

    def access(self, i: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(self.ranks, i, side="right") - 1
        inside = _BYTE_SELECT[self.high[byte], i - self.ranks[byte]]
        top = byte * 8 + inside - i
        if not self.low_bits:
            return top
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        part = part | np.where(over, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return top << self.low_bits | (part & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _until(self, high: np.ndarray) -> np.ndarray:
        """How many elements have at most these high bits: what stands before the zero of that number in the unary part."""
        byte = np.searchsorted(self.zeros, high, side="right") - 1
        inside = np.minimum(high - self.zeros[byte], 7)
        at = byte * 8 + _BYTE_SELECT[255 ^ self.high[np.minimum(byte, len(self.high) - 1)], inside] - high
        return np.where(byte >= len(self.high), self.n, np.minimum(at, self.n))

    def successor(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """First index in [lo, hi) whose element is at least ``value``, else hi. The high bits narrow the range, usually to an element or two."""
        high = np.maximum(value, 0) >> self.low_bits
        first = np.where(high > 0, self._until(np.maximum(high - 1, 0)), 0)
        lo = np.minimum(np.maximum(lo, first), hi)
        hi = np.maximum(np.minimum(hi, self._until(high)), lo)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.access(mid) < value[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ranks]


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logs / LOWEST * 65535), 0, 65535).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (LOWEST / 65535)


def quantise(values: np.ndarray) -> np.ndarray:
    """Codes of the log10 of values in (0, 1]."""
    return np.clip(np.rint(np.log10(np.maximum(values, 1e-300)) / LOWEST * (LEVELS - 1)), 0, LEVELS - 1).astype(np.uint16)


_values = np.append(10.0 ** (np.arange(LEVELS) * (LOWEST / (LEVELS - 1))), 0.0)


def restore(codes: np.ndarray) -> np.ndarray:
    """Values of codes; 0 for ``NONE``."""
    return _values[codes]


# --- Trie -----------------------------------------------------------------------------------------------------------


class Trie:
    """One shard: words (their numbers in the corpus), successors of a word, predecessors of a word, successors of (predecessor, word)."""

    SEQUENCES = ("words", "after", "after_at", "before", "before_at", "third", "third_at")
    CODES = ("f2", "g2", "f3", "g3")

    def __init__(self, sequences: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.sequences, self.codes = sequences, codes
        self.size = max(1, sequences["words"].n)

    @classmethod
    def build(cls, two: np.ndarray, three: np.ndarray, contexts: np.ndarray, totals: np.ndarray, pairs: np.ndarray, pair_totals: np.ndarray) -> Trie:
        """``two``: sorted rows (v, w, count) and ``three``: sorted rows (v, u, w, count), all kept ones; ``contexts``: words v with their ``totals``;
        ``pairs``: rows (v, u) with their ``pair_totals``. Contexts without anything kept need not be there."""
        words = np.unique(np.concatenate([np.unique(x) for x in (*two.T[:2], *three.T[:3])]))
        k, at = max(1, len(words)), lambda x: np.searchsorted(words, x)
        v, w = at(two[:, 0]), at(two[:, 1])
        f2 = (two[:, 2] - DISCOUNT) / totals[np.searchsorted(contexts, two[:, 0])]
        g2 = 1 - np.bincount(v, f2, k)
        key = at(three[:, 0]) * k + at(three[:, 1])
        before, of = np.unique(key, return_inverse=True)
        wide = int(pairs[:, 1].max()) + 1 if len(pairs) else 1
        own = np.searchsorted(pairs[:, 0] * wide + pairs[:, 1], three[:, 0] * wide + three[:, 1])
        f3 = (three[:, 3] - DISCOUNT) / pair_totals[own] if len(three) else np.zeros(0)
        g3 = 1 - np.bincount(of, f3, len(before))
        pointers = lambda x, n: EliasFano.build(np.searchsorted(x, np.arange(n + 1)))
        sequences = {
            "words": EliasFano.build(words), "after": EliasFano.build(v * k + w), "after_at": pointers(v, k), "before": EliasFano.build(before), "before_at": pointers(before // k, k),
            "third": EliasFano.build(of * k + at(three[:, 2])), "third_at": pointers(of, len(before)),
        }
        return cls(sequences, {"f2": quantise(f2), "g2": quantise(g2), "f3": quantise(f3), "g3": quantise(g3)})

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the shard; -1 for those that it lacks."""
        e = self.sequences["words"]
        return self._same(e, e.successor(np.zeros(len(words), np.int64), np.full(len(words), e.n), words), words, np.full(len(words), e.n)) if e.n else np.full(len(words), -1)

    def find(self, level: str, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each word under its context; -1 where there is none, or no context or word."""
        out = np.full(len(context), -1)
        k = np.flatnonzero((context >= 0) & (word >= 0))
        pointers, e = self.sequences[f"{level}_at"], self.sequences[level]
        if len(k) and e.n:
            lo, hi = pointers.access(context[k]), pointers.access(context[k] + 1)
            value = context[k] * self.size + word[k]
            out[k] = self._same(e, e.successor(lo, hi, value), value, hi)
        return out

    @staticmethod
    def _same(e: EliasFano, at: np.ndarray, value: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1)
        k = np.flatnonzero(at < end)
        if len(k):
            same = e.access(at[k]) == value[k]
            out[k[same]] = at[k[same]]
        return out

    def _places(self, *words: np.ndarray) -> list[np.ndarray]:
        """Places of some arrays of words; each distinct word is looked up once."""
        distinct, of = np.unique(np.concatenate(words), return_inverse=True)
        return list(self.numbers(distinct)[of].reshape(len(words), -1))

    def _code(self, name: str, at: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(at), none, np.uint16)
        k = np.flatnonzero(at >= 0)
        out[k] = self.codes[name][at[k]]
        return out

    def after(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Codes of f2 of words w after v."""
        return self.after_places(*self._places(v, w))

    def after_places(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """``after`` of words given as places in the shard."""
        return self._code("f2", self.find("after", v, w), NONE)

    def weight(self, v: np.ndarray) -> np.ndarray:
        """Codes of g2; that of 1 for words without anything kept after them."""
        return self._code("g2", self.numbers(v), 0)

    def third(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of g3 of contexts (u, v), that of 1 for unknown ones, and of f3 of words w after them."""
        return self.third_places(*self._places(v, u, w))

    def third_places(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``third`` of words given as places in the shard."""
        pair = self.find("before", v, u)
        return self._code("g3", pair, 0), self._code("f3", self.find("third", pair, w), NONE)

    def parts(self, v: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes f2, g2, f3, g3 of words w after v, and after u and v."""
        g3, f3 = self.third(v, u, w)
        return self.after(v, w), self.weight(v), f3, g3

    def to_bytes(self) -> bytes:
        """Header (number of parts, length of each), then the parts, each at a multiple of 8 bytes."""
        parts = [p for n in self.SEQUENCES for p in self.sequences[n].parts()] + [self.codes[n] for n in self.CODES]
        head = np.array([len(parts), *[len(p) for p in parts]], np.int64).tobytes()
        return head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        n = int(np.frombuffer(buffer, np.int64, 1)[0])
        lengths = np.frombuffer(buffer, np.int64, n, 8).tolist()
        at, parts = 8 + 8 * n, []
        kinds = [np.dtype(x) for x in ("i8", "u8", "u1", "i4")] * len(cls.SEQUENCES) + [np.dtype("u2")] * len(cls.CODES)
        for kind, length in zip(kinds, lengths, strict=True):
            parts.append(np.frombuffer(buffer, kind, length, at))
            at += length * kind.itemsize + -(length * kind.itemsize) % 8
        four = 4 * len(cls.SEQUENCES)
        sequences = {name: EliasFano(int(parts[4 * i][0]), int(parts[4 * i][1]), *parts[4 * i + 1 : 4 * i + 4]) for i, name in enumerate(cls.SEQUENCES)}
        return cls(sequences, dict(zip(cls.CODES, parts[four:], strict=True)))

    @classmethod
    def map(cls, path: str) -> Trie:
        """Memory-maps a file that holds ``to_bytes``."""
        return cls.from_buffer(np.memmap(path, np.uint8, "r"))


# --- Packed rows ----------------------------------------------------------------------------------------------------

END = b""  # no word is empty


def split_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes know only ASCII letters and spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 as bytes: planes of the bytes that are needed, compressed."""
    import zstandard

    out = []
    for a in arrays:
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        out += [struct.pack("<qb", len(a), width), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def expand(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<qb", raw, at)
        planes = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = planes.T
        out.append(a.view("<i8").ravel())
        at += 9 + n * width
    return out


def _steps(a: np.ndarray, restart: np.ndarray) -> np.ndarray:
    """Differences of an array that ascends between restarts, where it stands as it is."""
    out = np.diff(a, prepend=0)
    out[restart] = a[restart]
    return out


def _unsteps(d: np.ndarray, restart: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    first = np.flatnonzero(restart)
    base = np.zeros(len(d), np.int64)
    base[first] = total[first] - d[first]
    return total - base[np.maximum.accumulate(np.where(restart, np.arange(len(d)), 0))]


def pack_grams(v, w, u, n, counts) -> bytes:
    """Grams sorted by (v, w, u), with the corpus counts of their distinct v (0 if not hot). u is -1 for none and -2 for a bigram that stands alone."""
    new_v = np.diff(v, prepend=-1) != 0
    new_w = new_v | (np.diff(w, prepend=-1) != 0)
    return squeeze(np.diff(v, prepend=0), _steps(w, new_v), _steps(u + 2, new_w), n, counts)


def unpack_grams(data: bytes) -> tuple[np.ndarray, ...]:
    v, w, u, n, counts = _unpacked(data)
    return v, w, u - 2, n, counts[np.cumsum(starts(v)) - 1]


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """Columns v, w, u plus 2 and n; the counts as packed."""
    dv, dw, du, n, counts = expand(data)
    v = np.cumsum(dv)
    new_v = starts(v)
    w = _unsteps(dw, new_v)
    return v, w, _unsteps(du, new_v | starts(w)), n, counts


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits if they fit."""
    return x.astype(np.int32) if not len(x) or -(1 << 31) <= int(x.min()) and int(x.max()) < 1 << 31 else x


def starts(x: np.ndarray) -> np.ndarray:
    """Marks where a value differs from the one before; the first one does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, rank of each) of whole numbers from 0; by marks where the values are small enough for that, which is faster."""
    most = int(x.max(initial=0))
    if most > min(64 * len(x) + 1000, MARKS):
        values, rank = np.unique(x, return_inverse=True)
        return values.astype(np.int64), narrow(rank)
    seen = np.zeros(most + 1, bool)
    seen[x] = True
    rank = np.cumsum(seen, dtype=np.int32)
    rank -= 1
    return np.flatnonzero(seen), rank[x]


def _as_one(*ranked: np.ndarray) -> np.ndarray | None:
    """Columns of ranks as one number a row, in the same order; None if they do not fit."""
    bits = [int(x.max(initial=0)).bit_length() for x in ranked]
    if sum(bits) > 62:
        return None
    out = ranked[0].astype(np.int64)
    for x, b in zip(ranked[1:], bits[1:], strict=True):
        out <<= b
        out |= x
    return out


def in_order(*ranked: np.ndarray) -> np.ndarray:
    """The order of rows by their columns of ranks."""
    one = _as_one(*ranked)
    return np.lexsort(ranked[::-1]) if one is None else np.argsort(one)


def distinct(*ranked: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of columns of ranks, in order, column by column; then the number of each row among them."""
    order = narrow(in_order(*ranked))
    new = np.zeros(len(order), bool)
    for x in ranked:
        new |= starts(x[order])
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    first = order[new]
    return [*(x[first] for x in ranked), of]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 31-bit hashes of whole numbers."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(33)).astype(np.int64)


# --- Blocks ---------------------------------------------------------------------------------------------------------

BLOCKS = "block long, doc_ids array<{kind}>, held array<boolean>, lengths array<int>, ids binary, words binary, counts binary"


def _blocks(kind: pa.DataType):
    """Documents to blocks: token numbers, and the words with their counts in training texts. A block numbers its words in the order of a hash, so that
    those of a shard, which has a range of it, stand together."""
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def fresh():
            local = defaultdict()
            local.default_factory = local.__len__
            return local, [], [], [], []

        local, docs, held, lengths, ids = fresh()
        tokens = 0

        def close():
            flat, sizes, words = np.concatenate(ids), np.array(lengths), list(local)
            order = np.argsort(hashes(words), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            flat = rank[flat]
            counts = np.bincount(flat[np.repeat(~np.array(held), sizes)], minlength=len(local))
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([squeeze(flat)], pa.binary()), pa.array([_joined([words[i] for i in order.tolist()])], pa.binary()), pa.array([squeeze(counts)], pa.binary()),
            ], names=["block", "doc_ids", "held", "lengths", "ids", "words", "counts"])

        for batch in slices(batches):
            for d, t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = split_words(t)
                words.append(END)
                if tokens and tokens + len(words) > BLOCK:
                    yield close()
                    number += 1
                    local, docs, held, lengths, ids = fresh()
                    tokens = 0
                ids.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
                docs.append(d), held.append(h), lengths.append(len(words))
                tokens += len(words)
        if tokens:
            yield close()

    return run


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words))


def _joined(words: list[bytes]) -> bytes:
    """Words hold no space, so spaces part them."""
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(b" ".join(words))


def _parted(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


MAIL = "shard int, block long, data binary, more binary"
_MAIL = ["shard", "block", "data", "more"]


def _mail(shards, blocks, data, more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], names=_MAIL)


def _groups(batches, key: int):
    """(value, rows) of rows that come sorted by a column."""
    now, held = None, []
    for batch in slices(batches, 64):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _at_shards(mail: DataFrame, work) -> DataFrame:
    return mail.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(work, MAIL)


# --- Words ----------------------------------------------------------------------------------------------------------


def _word_shards(shards: int):
    """Block rows to one row for each shard: the block's words of it, in the block's order, and their counts."""
    def run(batches):
        for batch in slices(batches, 1):
            words, (counts,) = _parted(batch.column("words")[0].as_py()), expand(batch.column("counts")[0].as_py())
            cut = np.searchsorted(hashes(words) * shards >> 32, np.arange(shards + 1)).tolist()
            parts = [(s, slice(cut[s], cut[s + 1])) for s in range(shards) if cut[s] < cut[s + 1]]
            yield _mail([s for s, _ in parts], [batch.column("block")[0].as_py()] * len(parts), [_joined(words[p]) for _, p in parts], [squeeze(counts[p]) for _, p in parts])

    return run


def _count_words():
    """At a shard: sums the counts of each word, numbers the words by rank, and answers each block with numbers and counts.

    A row with block -1 has the shard's sums: tokens, words that occur, once, and twice.
    """
    def run(batches):
        for shard, rows in _groups(batches, 0):
            local = defaultdict()
            local.default_factory = local.__len__
            asked = []
            for _, block, words, counts in rows:
                parted = _parted(words)
                asked.append((block, np.fromiter(map(local.__getitem__, parted), np.int64, len(parted)), expand(counts)[0]))
            total = np.zeros(len(local), np.int64)
            for _, at, counts in asked:
                total[at] += counts  # a block has a word once
            rank = np.empty(len(local), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(local))
            yield _mail([shard], [-1], [squeeze(np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()]))], [None])
            for block, at, _ in asked:
                yield _mail([shard], [block], [squeeze(rank[at], total[at])], [None])

    return run


# --- Grams ----------------------------------------------------------------------------------------------------------


def numbered(shards: list[int], answers: list[bytes], of: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the corpus (rank in the shard times the number of shards plus the shard) and counts of a block's words, in the order of shards."""
    parts = [(rank * of + s, count) for s, (rank, count) in zip(shards, map(expand, answers), strict=True)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


class Block:
    """A block that knows its words' numbers and counts in the corpus: its tokens and its distinct grams."""

    def __init__(self, row: dict, word_shards: int):
        # In the order of shards, which is that of the block's own numbers; from here on words are numbered by rank in the corpus.
        number, count = numbered(row["shards"], row["answers"], word_shards)
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number, self.count = number[order], count[order]
        self.token = rank[expand(row["ids"])[0]]
        self.sizes, self.held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        place = np.arange(len(self.token)) - np.repeat(self.first, self.sizes)
        known = (self.count >= LEAST)[self.token]
        # Tokens after a word that may be a context; the word before that one; each with its own. 0 is a rare word, or none.
        self.where = np.flatnonzero((place >= 1) & np.roll(known, 1))
        ranked = np.where(known, self.token + 1, 0)
        v, w, u = self.token[self.where - 1], ranked[self.where], np.where(place[self.where] >= 2, ranked[self.where - 2], 0)
        size = len(self.number) + 1
        if size**3 < 1 << 63:
            triple, self.of = np.unique((v * size + w) * size + u, return_inverse=True)
            pair = triple // size
        else:
            pairs, of = np.unique(v * size + w, return_inverse=True)
            triple, self.of = np.unique(of * size + u, return_inverse=True)
            pair = pairs[triple // size]
        self.u, self.v = triple % size - 1, pair // size
        self.w = pair - self.v * size - 1
        train = np.repeat(~self.held, self.sizes)[self.where]
        self.n = np.bincount(self.of[train], minlength=len(triple))

    def grams(self, shards: int):
        """(shard, places among the block's grams, v, w, u, n) of what each shard is asked; v, w, u as numbers in the corpus plus 1 (0: a rare word).

        Grams of hot words go twice: bigrams, marked with u = -2, to the shard of v and w, trigrams to that of v and u.
        """
        c = self.count[self.v]
        v, w, u = self.number[self.v] + 1, np.where(self.w >= 0, self.number[self.w] + 1, 0), np.where(self.u >= 0, self.number[self.u] + 1, -1)
        split = 1 + c // HOT
        hot = np.flatnonzero(split > 1)
        shard = mixed(self.number + 1)[self.v]
        if len(hot):
            shard[hot] += mixed(u[hot]) % split[hot] * 7919
        shard %= shards
        first = hot[np.flatnonzero(np.diff(v[hot] * (int(w.max(initial=0)) + 1) + w[hot], prepend=-1) != 0)]
        self.hot, self.group, self.alone, n = hot, np.searchsorted(first, hot, side="right") - 1, len(v), self.n
        if len(first):
            n = np.concatenate((n, np.bincount(self.group, n[hot], len(first)).astype(np.int64)))
            shard = np.concatenate((shard, (mixed(v[first]) + mixed(w[first]) % split[first] * 7919) % shards))
            v, w, u, c = (np.concatenate((x, y)) for x, y in ((v, v[first]), (w, w[first]), (u, np.full(len(first), -2)), (c, c[first])))
            order = np.lexsort((u, w, v, shard))
        else:  # grams are sorted already
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            if cut[s] < cut[s + 1]:
                at = order[cut[s] : cut[s + 1]]
                yield s, at, v[at], w[at], u[at], n[at], c[at]


def _ask_grams(word_shards: int, shards: int):
    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            for s, _, v, w, u, n, c in Block(row, word_shards).grams(shards):
                yield _mail([s], [row["block"]], [pack_grams(v, w, u, n, np.where(c >= HOT, c, 0)[np.diff(v, prepend=-1) != 0])], [None])

    return run


def _distinct_grams(columns: list[list[np.ndarray]]) -> tuple:
    """Columns v, w, u, n, in parts, which it empties: the values of v, w, u; the distinct grams as ranks among these; their counts; each row's gram."""
    values, ranked = [], []
    for parts in columns[:3]:
        x = np.concatenate(parts)
        parts.clear()
        value, rank = ranks(x)
        values.append(value), ranked.append(rank)
    *found, of = distinct(*ranked)
    del x, rank, ranked
    n = np.concatenate(columns[3])
    columns[3].clear()
    return values, found, np.bincount(of, n, len(found[0])).astype(np.int64), of


def gather_grams(packed: list[bytes]) -> tuple:
    """From what blocks sent, which it takes out of the list: ``_distinct_grams`` of all of it, with the rows' grams as an array for each block; then the hot
    words with their counts. Some ``GATHER`` rows at once become distinct grams, and these then meet: what blocks repeat is never there as often."""
    packed.reverse()
    columns, sizes, pieces, names, told = [[], [], [], []], [], [], [], []
    while packed:
        *rows, counts = _unpacked(packed.pop())
        sizes.append(len(rows[0]))
        names.append(rows[0][starts(rows[0])][counts > 0]), told.append(counts[counts > 0])
        for parts, x in zip(columns, rows, strict=True):
            parts.append(narrow(x))
        if not packed or sum(map(len, columns[0])) >= GATHER:
            pieces.append(_distinct_grams(columns))
    values, found, count, of = pieces.pop() if len(pieces) == 1 else (None,) * 4
    if pieces:
        columns = [[narrow(values[k][found[k]]) for values, found, _, _ in pieces] for k in range(3)] + [[count for _, _, count, _ in pieces]]
        rows = [of for _, _, _, of in pieces]
        ends = np.cumsum([len(x) for x in columns[0]])
        pieces.clear()
        values, found, count, at = _distinct_grams(columns)
        of = np.concatenate([part[x] for part, x in zip(np.split(at, ends[:-1]), rows, strict=True)])
    return values, found, count, np.split(of, np.cumsum(sizes)[:-1]), np.concatenate(names), np.concatenate(told)


def _count_grams(batches):
    """At a shard: sums the counts of grams, keeps those of ``LEAST``, builds the shard's trie, and answers each block's grams by querying it.

    A row with block -1 has the trie (``data``), and the sums of f2 of hot words (``more``), whose bigrams lie in several shards.
    """
    for shard, rows in _groups(batches, 0):
        blocks, packed = [block for _, block, _, _ in rows], [data for _, _, data, _ in rows]
        rows.clear()
        yield from _at_shard(shard, blocks, packed)  # what it holds goes before the next shard comes


def _at_shard(shard: int, blocks: list[int], packed: list[bytes]):
    # Grams as ranks among the values of each column (us: of u plus 2), 32 bits wide as a rule.
    (vs, ws, us), (vi, wi, ui), count, of, names, counts = gather_grams(packed)
    word, told = ws > 0, np.zeros(len(vs), np.int64)
    told[np.searchsorted(vs, names)] = counts
    hot = told > 0
    # A word that is not hot has all its grams here, so their counts sum to its own.
    total = np.where(hot, told, np.bincount(vi, count, len(vs)).astype(np.int64))
    # Bigrams: of hot words those that stand alone, of others all grams together.
    new = starts(vi) | starts(wi)
    of_pair, pair = np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)
    mine = ~hot[vi] | (us == 0)[ui]
    n2 = np.bincount(of_pair[mine], count[mine], len(pair)).astype(np.int64)
    keep2 = np.flatnonzero((n2 >= LEAST) & word[wi[pair]])
    v2, w2 = vi[pair[keep2]], wi[pair[keep2]]
    two = np.stack((vs[v2], ws[w2], n2[keep2]), 1)
    # Trigrams, by (v, u, w); the count of a context (u, v) is that of all words after it.
    third = narrow(np.flatnonzero((us > 2)[ui]))
    order = third[in_order(vi[third], ui[third], wi[third])]
    new = starts(vi[order]) | starts(ui[order])
    context, start = np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)
    pairs = np.stack((vs[vi[order[start]]], us[ui[order[start]]] - 2), 1)
    pair_totals = np.add.reduceat(count[order], start) if len(order) else np.zeros(0, np.int64)
    kept = (count[order] >= LEAST) & word[wi[order]]
    keep3 = order[kept]
    three = np.stack((vs[vi[keep3]], us[ui[keep3]] - 2, ws[wi[keep3]], count[keep3]), 1)
    # Only what was kept can be found; all of it is.
    full = np.zeros(len(pairs), bool)
    full[context[kept]] = True
    near = order[full[context]]
    pairs, pair_totals = pairs[full], pair_totals[full]
    del third, order, context, new, start, full, mine, kept, keep3, count
    trie = Trie.build(two, three, vs, total, pairs, pair_totals)
    del three, pairs, pair_totals
    data = trie.to_bytes()
    trie = Trie.from_buffer(data)
    v_at, w_at, u_at = trie.numbers(vs), trie.numbers(ws), trie.numbers(us - 2)
    f2, f3, g3 = np.full(len(pair), NONE, np.uint16), np.full(len(vi), NONE, np.uint16), np.zeros(len(vi), np.uint16)
    for k in range(0, len(keep2), LOOK):
        part = slice(k, k + LOOK)
        f2[keep2[part]] = trie.after_places(v_at[v2[part]], w_at[w2[part]])
    for k in range(0, len(near), LOOK):
        part = near[k : k + LOOK]
        g3[part], f3[part] = trie.third_places(v_at[vi[part]], u_at[ui[part]], w_at[wi[part]])
    g2 = np.where(hot, 0, trie._code("g2", v_at, 0))
    f2 = f2[of_pair]
    heavy = np.flatnonzero(hot[v2])
    names, at = np.unique(two[heavy, 0], return_inverse=True)
    sums = np.bincount(at, two[heavy, 2] - DISCOUNT, len(names))
    del near, of_pair, pair, wi, ui, two
    yield _mail([shard], [-1], [data], [squeeze(names, np.rint(sums * 4).astype(np.int64))])
    for block, part in zip(blocks, of, strict=True):
        context = vi[part]
        # g2 once for each word; the code of what was not kept becomes 0.
        yield _mail([shard], [block], [squeeze((f2[part] + 1) % (NONE + 1), g2[context[starts(context)]], (f3[part] + 1) % (NONE + 1), g3[part])], [None])


# --- Scores ---------------------------------------------------------------------------------------------------------


def _score(word_shards: int, shards: int, total: int, kinds: int, d1: float):
    unknown = d1 * kinds / total if total else 1.0

    def scored(batch):
        row = batch.to_pylist()[0]
        b = Block(row, word_shards)
        answers = dict(zip(row["gram_shards"] or (), row["gram_answers"] or (), strict=True))
        codes = None
        for s, at, v, *_ in b.grams(shards):
            if codes is None:
                codes = np.zeros((4, b.alone + int(b.group.max(initial=-1)) + 1), np.int64)
            f2, g2, f3, g3 = expand(answers[s])
            codes[:, at] = f2 - 1, g2[np.cumsum(np.diff(v, prepend=-1) != 0) - 1], f3 - 1, g3
        c = b.count
        base_of = np.log10((c + 1) / (total + kinds + 1))
        p = (np.where(c > 0, (c - d1) / total, unknown) if total else np.ones(len(c)))[b.token]
        if codes is not None:
            f2, g2, f3, g3 = restore(codes)
            f2[b.hot] = f2[b.alone + b.group]
            if row["hot"]:
                names, kept = (np.array([x[k] for x in sorted(dict(row["hot"]).items())]) for k in range(2))
                at = np.minimum(np.searchsorted(names, b.number[b.v] + 1), len(names) - 1)
                heavy = names[at] == b.number[b.v] + 1
                g2[: len(heavy)][heavy] = 1 - kept[at[heavy]] / c[b.v[heavy]]
            lower = f2[b.of] + g2[b.of] * p[b.where]
            p[b.where] = f3[b.of] + g3[b.of] * lower
        logs = np.log10(np.maximum(p, 1e-300))
        sums = [np.add.reduceat(x, b.first) for x in (base_of[b.token], logs, (c[b.token] > 0).astype(np.int64))]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_ids")[0].values, pa.array(b.held), pa.array(b.sizes), pa.array(sums[2]), pa.array(np.full(len(b.sizes), total)), pa.array(sums[0]), pa.array(np.minimum(sums[1], 0.0))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        for batch in slices(batches, 1):
            yield scored(batch)  # what it holds goes before the next block comes

    return run


def score_documents(documents: DataFrame) -> DataFrame:
    """From (doc_id, text, held_out): the columns of op5."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = pick(documents, "doc_id", "text", "held_out")
    kind = docs.schema["doc_id"].dataType
    blocks = materialize(docs.mapInArrow(_blocks(to_arrow_type(kind)), BLOCKS.format(kind=kind.simpleString())), "lm-blocks", 256)
    # Shards are as many as the corpus is large, by the tokens and words that its blocks have.
    tokens = blocks.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    word_shards, shards = 1 + tokens // WORDS, 1 + tokens // SHARD
    words = materialize(_at_shards(blocks.select("block", "words", "counts").mapInArrow(_word_shards(word_shards), MAIL), _count_words()), "lm-words", 16)
    sums = np.zeros(4, np.int64)
    for r in words.where("block = -1").select("data").toLocalIterator():  # four numbers a shard
        sums += expand(r["data"])[0]
    total, kinds, once, twice = sums.tolist()
    d1 = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    told = words.where("block >= 0").groupBy(F.col("block").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("shard", "data"))).alias("a")).select("b", F.col("a.shard").alias("shards"), F.col("a.data").alias("answers"))
    known = blocks.select("block", "doc_ids", "held", "lengths", "ids").join(told, F.col("block") == F.col("b")).drop("b")
    asked = known.drop("doc_ids").mapInArrow(_ask_grams(word_shards, shards), MAIL)
    grams = materialize(_at_shards(asked, _count_grams), "lm-grams", 16)
    answers = grams.where("block >= 0").groupBy(F.col("block").alias("gb")).agg(F.collect_list("shard").alias("gram_shards"), F.collect_list("data").alias("gram_answers"))
    rows = known.join(answers, F.col("block") == F.col("gb"), "left").drop("gb")
    rows = rows.join(hot_sums(grams, told, word_shards), F.col("block") == F.col("hb"), "left").drop("hb")
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return materialize(rows.mapInArrow(_score(word_shards, shards, total, kinds, d1), schema), "lm-scores", 2)


def hot_sums(grams: DataFrame, told: DataFrame, word_shards: int) -> DataFrame:
    """(hb, hot): for each block, a map of its hot words to what their bigrams of all shards sum to. Words and sums meet in a join by word."""
    def partial(batches):
        for batch in slices(batches, 64):
            for more in batch.column(0).to_pylist():
                names, sums = expand(more)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums / 4)], names=["name", "kept"])

    def own(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            number, count = numbered(row["shards"], row["answers"], word_shards)
            names = number[count >= HOT] + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), row["b"])), pa.array(names)], names=["hb", "word"])

    sums = grams.where("block = -1").select("more").mapInArrow(partial, "name long, kept double").groupBy("name").agg(F.sum("kept").alias("kept"))
    words = told.mapInArrow(own, "hb long, word long")
    return words.join(sums, F.col("word") == F.col("name")).groupBy("hb").agg(F.map_from_entries(F.collect_list(F.struct("word", "kept"))).alias("hot"))


def op5_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_documents(docs.withColumn("held_out", remainder(7) == 2))
