"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags tokens as secret begin (B), inside (I) or outside (O). Features are a token's shape and length class, the
shapes and folded words around it, and features of the file. It is trained by gradient ascent on windows around the
pattern spans of a bounded sample, on windows without secrets, and on ``MADE`` generated lines with secrets of known shapes
(bearer tokens, provider keys). Viterbi decodes every token of every text. What a token adds to the scores of its own and of its neighbours'
places does not depend on where it stands, so a worker works it out once for each distinct token; the texts of a batch then go
through one exact Viterbi in step, in blocks of ``STEP`` tokens.

The pattern spans always stay; the field adds spans that do not overlap them. Positions are code points, end exclusive.

Edge cases: null, empty and blank texts have no spans; repeated rows each get a row; texts of any length are scanned
whole; without pattern spans in the sample the field learns from generated lines alone; columns beside doc_id and text may have any names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_ids, over_texts, pick, sampled, table

#: Bounds of the fit: documents of the sample, windows kept of all, windows taken of one text with and without secrets, generated lines.
SAMPLE, WINDOWS, WITH, WITHOUT, MADE = 8_000, 1_500, 3, 2, 600
#: Tokens of a block in decoding, and distinct tokens that a worker remembers.
STEP, REMEMBERED = 64, 200_000
DIM = 1 << 13
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_access = re.compile(r"AKIA[A-Z0-9]{12,}")
_hex = re.compile(r"[0-9a-f]{32,}")
_keys = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_token = re.compile(r"[^\s\"'<>(){}\[\],;:=&|*#$%!?]+|[:=]")
KINDS = ("assign", "access", "hex", "crf")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if _keys.search(text):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


class _Kinds(dict):
    """Code point -> the letter that stands for its class in a shape."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "-_./+:=@~" else "?"
        return k


_kinds, _runs = _Kinds(), re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """Letter classes with runs squeezed: Ab12-x -> Aa0-a."""
    return _runs.sub(r"\1", token[:64].translate(_kinds))[:8]


@lru_cache(1 << 16)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % DIM


_LENGTHS = (1, 2, 4, 8, 12, 16, 20, 24, 32, 40, 64)


def own_features(token: str) -> list[int]:
    size, kinds = max(1, len(token)), token.translate(_kinds)
    n, digits, upper = bisect_right(_LENGTHS, len(token)), kinds.count("0"), kinds.count("A")
    return [_bucket(f) for f in (
        f"s:{shape(token)}", f"n:{n}", f"d:{min(4, 5 * digits // size)}:{n}", f"u:{min(4, 5 * upper // size)}:{n}", f"k:{min(4, 5 * len(set(token)) // size)}:{n}",
        f"m:{digits > 0}{upper > 0}{digits + upper < len(token)}:{n}", f"p:{token[:4].lower()}",
    )]


def near_features(token: str, *places: int) -> list[int]:
    """Two features for each place relative to the token in question: its folded letters and its shape."""
    folded, squeezed = token[:16].lower(), shape(token)
    return [b for at in places for b in (zlib.crc32(f"w{at}:{folded}".encode("utf-8", "replace")) % DIM, _bucket(f"ws{at}:{squeezed}"))]


def file_features(text: str) -> list[int]:
    size = max(1, len(text))
    return [_bucket(f"f:{bool(_keys.search(text))}"), _bucket(f"e:{min(3, 200 * text.count('=') // size)}")]


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _token.finditer(text, start, len(text) if end is None else end)]


#: Scores of the tags of a text's first token: it is not inside.
START = np.array([0.0, -20.0, 0.0])


class Field:
    """Weights: emission (DIM x 3) for B, I, O and transitions (3 x 3) from row to column."""

    def __init__(self):
        self.emit, self.trans = np.zeros((DIM, 3)), np.zeros((3, 3))
        self.trans[2, 1] = -20.0  # inside never follows outside

    def features(self, words: list[str], file: list[int]) -> list[list[int]]:
        out = []
        for i, w in enumerate(words):
            f = own_features(w) + file
            for d in (-2, -1, 1):
                f += near_features(words[i + d] if 0 <= i + d < len(words) else "", d)
            out.append(f)
        return out

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(0) for f in rows]).reshape(-1, 3)

    def _forward(self, e):
        a = np.zeros_like(e)
        a[0] = START + e[0]
        for t in range(1, len(e)):
            m = a[t - 1][:, None] + self.trans
            top = m.max(0)
            a[t] = top + np.log(np.exp(m - top).sum(0)) + e[t]
        b = np.zeros_like(e)
        for t in range(len(e) - 2, -1, -1):
            m = self.trans + e[t + 1] + b[t + 1]
            top = m.max(1)
            b[t] = top + np.log(np.exp(m - top[:, None]).sum(1))
        z = a[-1].max() + np.log(np.exp(a[-1] - a[-1].max()).sum())
        return a, b, z

    def train(self, data: list[tuple[list[list[int]], list[int]]], epochs: int = 4, rate: float = 0.15, decay: float = 1e-4) -> None:
        rng = random.Random(0)
        fixed = self.trans[2, 1]
        for epoch in range(epochs):
            order = list(range(len(data)))
            rng.shuffle(order)
            r = rate / (1 + epoch)
            for i in order:
                rows, tags = data[i]
                e = self.emissions(rows)
                a, b, z = self._forward(e)
                p = np.exp(a + b - z)
                for t, (f, tag) in enumerate(zip(rows, tags, strict=True)):
                    g = -p[t]
                    g[tag] += 1
                    self.emit[f] += r * (g - decay * self.emit[f])
                    if t:
                        q = np.exp(a[t - 1][:, None] + self.trans + e[t] + b[t] - z)
                        self.trans -= r * q
                        self.trans[tags[t - 1], tag] += r
                self.trans[2, 1] = fixed
        self.trans = np.clip(self.trans, -20.0, 5.0)

    def viterbi(self, e: np.ndarray) -> list[int]:
        score, back = START + e[0], []
        for t in range(1, len(e)):
            m = score[:, None] + self.trans
            back.append(m.argmax(0))
            score = m.max(0) + e[t]
        tags = [int(score.argmax())]
        for k in reversed(back):
            tags.append(int(k[tags[-1]]))
        return tags[::-1]


#: Buckets of features that depend on small numbers, as tables.
_SIZES = range(len(_LENGTHS) + 1)
_length_bucket = np.array([_bucket(f"n:{n}") for n in _SIZES])
_share_bucket = {c: np.array([[_bucket(f"{c}:{v}:{n}") for n in _SIZES] for v in range(5)]) for c in "duk"}
_mix_bucket = np.array([[[[_bucket(f"m:{d}{u}{r}:{n}") for n in _SIZES] for r in (False, True)] for u in (False, True)] for d in (False, True)])
_near_start = [zlib.crc32(f"w{at}:".encode()) for at in (-2, -1, 1)]


@lru_cache(1 << 16)
def _shape_buckets(squeezed: str) -> tuple:
    return (_bucket(f"s:{squeezed}"), *(_bucket(f"ws{at}:{squeezed}") for at in (-2, -1, 1)))


class Tokens(dict):
    """Token -> its number. ``rows`` has what each adds to the scores (B, I, O) of its own place and of the places 2 and 1 after and 1 before it.

    New tokens are numbered as they come and worked out together by ``fill``: the features of ``own_features`` and ``near_features``, in columns.
    """

    def __init__(self, field: Field):
        self.field, self.rows, self.fresh = field, np.zeros((0, 4, 3)), []

    def __missing__(self, token: str) -> int:
        self.fresh.append(token)
        self[token] = k = len(self)
        return k

    def fill(self) -> None:
        tokens, self.fresh = self.fresh, []
        if not tokens:
            return
        kinds = [t.translate(_kinds) for t in tokens]
        numbers = lambda values: np.fromiter(values, np.int64, len(tokens))
        length, digits, upper = numbers(map(len, tokens)), numbers(k.count("0") for k in kinds), numbers(k.count("A") for k in kinds)
        n, size = np.searchsorted(_LENGTHS, length, side="right"), np.maximum(length, 1)
        share = lambda c, x: _share_bucket[c][np.minimum(4, 5 * x // size), n]
        shapes = np.array([_shape_buckets(_runs.sub(r"\1", k[:64])[:8]) for k in kinds])
        folded = [t[:16].lower().encode("utf-8", "replace") for t in tokens]
        at = np.empty((len(tokens), 13), np.int64)
        at[:, 0], at[:, 1], at[:, 2], at[:, 3], at[:, 4] = shapes[:, 0], _length_bucket[n], share("d", digits), share("u", upper), share("k", numbers(len(set(t)) for t in tokens))
        at[:, 5], at[:, 6] = _mix_bucket[(digits > 0).astype(int), (upper > 0).astype(int), (digits + upper < length).astype(int), n], numbers(_bucket(f"p:{t[:4].lower()}") for t in tokens)
        for k, start in enumerate(_near_start):
            at[:, 7 + 2 * k] = numbers(zlib.crc32(f, start) for f in folded)
            at[:, 8 + 2 * k] = shapes[:, 1 + k]
        scores = self.field.emit[at % DIM]
        made = np.stack([scores[:, a:b].sum(1) for a, b in ((0, 7), (7, 9), (9, 11), (11, 13))], 1)
        self.rows = np.concatenate((self.rows, made))


#: Whether a code point below the table's end is inside a token; those above are.
_inside = np.array([bool(re.match(r"[^\s\"'<>(){}\[\],;:=&|*#$%!?]", chr(c))) for c in range(0x3001)])


def token_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of ``_token``, in code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(c) + 2, bool)
    inside[1:-1] = _inside[np.minimum(c, 0x3000)] | (c > 0x3000)
    alone = np.flatnonzero((c == ord(":")) | (c == ord("=")))
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.sort(np.concatenate((starts, alone))), np.sort(np.concatenate((ends, alone + 1)))


def viterbi_in_step(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags of a long sequence that starts outside, by blocks in step: what each block makes of each entry state, then the entries, then the tags."""
    n = len(e)
    blocks = -(-n // STEP)
    padded = np.zeros((blocks * STEP, 3))
    padded[:n] = e
    padded[n:, :2] = -1e9
    grid = np.ascontiguousarray(padded.reshape(blocks, STEP, 3).transpose(1, 2, 0))  # step, state, block
    never = -1e18
    # From each entry state: the best score of each state after the block.
    score = np.full((3, 3, blocks), never)
    for s in range(3):
        score[s, s] = 0.0
    for t in range(STEP):
        score = np.stack([np.maximum(np.maximum(score[:, 0] + trans[0, s], score[:, 1] + trans[1, s]), score[:, 2] + trans[2, s]) + grid[t, s] for s in range(3)], 1)
    entry = np.empty((blocks, 3))
    now = np.array([never, never, 0.0])
    for k, m in enumerate(np.ascontiguousarray(score.transpose(2, 0, 1))):
        entry[k] = now
        now = (now[:, None] + m).max(0)
        now -= now.max()
    at, back = np.ascontiguousarray(entry.T), np.empty((STEP, 3, blocks), np.int8)
    for t in range(STEP):
        after = np.empty_like(at)
        for s in range(3):
            a, b, c = at[0] + trans[0, s], at[1] + trans[1, s], at[2] + trans[2, s]
            best = np.maximum(np.maximum(a, b), c)
            back[t, s] = np.where(a == best, 0, np.where(b == best, 1, 2))
            after[s] = best + grid[t, s]
        at = after
    # Where each exit state of a block comes from; then the exits, last block first.
    state, every = np.tile(np.arange(3, dtype=np.int8)[:, None], (1, blocks)), np.arange(blocks)
    for t in range(STEP - 1, -1, -1):
        state = back[t, state, every]
    came = np.ascontiguousarray(state.T).tolist()
    exits, x = [0] * blocks, int(at[:, -1].argmax())
    for k in range(blocks - 1, -1, -1):
        exits[k] = x
        x = came[k][x]
    tags, x = np.empty((STEP, blocks), np.int8), np.array(exits, np.int8)
    for t in range(STEP - 1, -1, -1):
        tags[t] = x
        x = back[t, x, every]
    return tags.T.reshape(-1)[:n]


class Scanner:
    """Finds spans with a trained field."""

    def __init__(self, field: Field):
        self.field = field

    def __getstate__(self):
        return {"field": self.field}

    def tags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, ends, tags) of the tokens of each text."""
        known = self.__dict__.get("known")
        if known is None or len(known) > REMEMBERED:
            known = self.known = Tokens(self.field)
        numbers, places = [], []
        for t in texts:
            places.append(token_places(t))
            numbers.append(np.fromiter(map(known.__getitem__, _token.findall(t)), np.int64, len(places[-1][0])))
        sizes = np.array([len(x) for x in numbers])
        nothing = known[""]  # what stands beyond the edges of a text
        known.fill()
        # A place of silence stands between texts and at both ends: only O is possible there.
        e = np.zeros((int(sizes.sum()) + len(texts) + 1, 3))
        first = np.cumsum(sizes + 1) - sizes
        silent = np.append(first - 1, len(e) - 1)
        own, two, one, next_ = (known.rows[:, k] for k in range(4))
        for k, x in enumerate(numbers):
            if not len(x):
                continue
            around = np.concatenate(([nothing, nothing], x, [nothing]))
            part = own[x] + two[around[:-3]] + one[around[1:-2]] + next_[around[3:]] + self.field.emit[file_features(texts[k])].sum(0)
            part[0] += START - self.field.trans[2]
            part[-1] -= self.field.trans[:, 2]
            e[first[k] : first[k] + len(x)] = part
        e[silent, :2] = -1e9
        found = viterbi_in_step(e, self.field.trans)
        return [(*p, found[a : a + n]) for p, a, n in zip(places, first.tolist(), sizes.tolist(), strict=True)]

    def decoded(self, starts, ends, tags, busy: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of the tags (B and the I after it) that overlap no busy one."""
        out = []
        for k in np.flatnonzero(tags == 0).tolist():
            j = k + 1
            while j < len(tags) and tags[j] == 1:
                j += 1
            a, b = int(starts[k]), int(ends[j - 1])
            if all(b <= x or a >= y for x, _, y in busy):
                out.append((a, 3, b))
        return out

    def decode(self, text: str, busy: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        return self.decoded(*self.tags([text])[0], busy)

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """All spans of each text: those of the patterns, and those that the field adds."""
        base = [base_spans(t or "") for t in texts]
        return [sorted(b + self.decoded(*found, b)) for b, found in zip(base, self.tags([t or "" for t in texts]), strict=True)]


def made_lines(n: int = MADE, seed: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with spans of secrets: half of them have none."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"

    def run(alphabet, a, b):
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))

    def word():
        return run(letters, 2, 9)

    def secret():
        return rng.choice((
            lambda: run("0123456789abcdef", 32, 64), lambda: "AKIA" + run("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 16), lambda: "ghp_" + run(mixed, 36, 36),
            lambda: "sk-" + run(mixed, 24, 48), lambda: run(mixed, 24, 40), lambda: run(mixed + "+/", 40, 40), lambda: "xoxb-" + run("0123456789", 10, 12) + "-" + run(mixed, 24, 24),
            lambda: run(mixed, 12, 12) + "." + run(mixed + "_-", 20, 30) + "." + run(mixed, 20, 20)))()

    def harmless():
        return rng.choice((
            lambda: f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"{word()}.{rng.randint(1, 99)}@{word()}.example.com",
            lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: run("0123456789", 1, 16), lambda: f"https://{word()}.org/{word()}/{rng.randint(1, 999)}",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{word()}-{word()}", lambda: f"{word()}_{word()}", lambda: f"{word()}={rng.randint(0, 99)}", lambda: run(letters, 20, 34)))()

    out = []
    for k in range(n):
        before, after = " ".join(word() for _ in range(rng.randint(2, 6))), " ".join(word() for _ in range(rng.randint(2, 6)))
        if k % 2:
            lead = rng.choice(("token = \"", "Authorization: Bearer ", "key: ", "export SECRET=", "api_key='", "credential ", "password: ", ""))
            s = secret()
            head = f"{before} {lead}"
            out.append((f"{head}{s}{rng.choice(('', chr(34), chr(39)))} {after}", [(len(head), len(head) + len(s))]))
        else:
            out.append((f"{before} {harmless()} {word()} {harmless()} {after}", []))
    return out


def example(text: str, secrets: list[tuple[int, int]], field: Field, file: list[int]) -> tuple | None:
    spans = tokens_of(text)
    if not spans:
        return None
    tags = []
    for a, b in spans:
        inside = next(((x, y) for x, y in secrets if a < y and b > x), None)
        tags.append(2 if inside is None else 1 if tags and tags[-1] != 2 and a > inside[0] else 0)
    return field.features([text[a:b] for a, b in spans], file), tags


def values(spans: list[tuple[int, int, int]], text: str) -> list[tuple[int, int]]:
    """The secrets themselves: of an assignment, the value."""
    out = []
    for a, kind, b in spans:
        m = _assign.match(text, a) if kind == 0 else None
        out.append((m.start(2), m.end(2)) if m else (a, b))
    return out


_odd = re.compile(r"\S*[0-9_+/=@~\\-]\S*|\S{25,}")


def sample_windows(text: str, reach: int = 80) -> list[dict]:
    """Windows of a text to learn from, chosen by a hash: around ``WITH`` secrets, and around ``WITHOUT`` odd tokens and one of any kind far from all.

    Every secret that lies whole in a window is marked; a window that would cut one is left out.
    """
    base = base_spans(text)
    marks = values(base, text)
    order = lambda span: (zlib.crc32(text[span[0] : span[1]].encode("utf-8", "replace")), span)
    far = lambda m: all(m[1] + reach < a or m[0] - reach > b for a, _, b in base)
    centres = sorted(marks, key=order)[:WITH]
    centres += sorted(filter(far, (m.span() for m in _odd.finditer(text))), key=order)[:WITHOUT]
    centres += sorted(filter(far, tokens_of(text)), key=order)[:1]
    out = []
    for a, b in centres:
        lo, hi = max(0, a - reach), min(len(text), b + reach)
        if not any(x < lo < y or x < hi < y for x, y in marks):
            inside = [(x - lo, y - lo) for x, y in marks if lo <= x and y <= hi]
            out.append({"text": text[lo:hi], "starts": [x for x, _ in inside], "ends": [y for _, y in inside]})
    return out


def fit(documents: DataFrame, sample: int = SAMPLE) -> Field:
    docs = pick(documents, "doc_id", "text")
    chosen = hashed_ids(docs, sample)
    kind = "struct<text:string,starts:array<int>,ends:array<int>>"
    shape = pa.list_(pa.struct([("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))
    windows = over_texts(f"array<{kind}>", lambda texts: pa.array([sample_windows(t or "") for t in texts], shape))
    rows = sampled(docs, chosen).select(F.explode(windows("text")).alias("w")).select("w.*")
    has = F.size("starts") > 0
    got = [r for part in (rows.where(has), rows.where(~has)) for r in part.distinct().orderBy(F.xxhash64("text", "starts"), "text", "starts").limit(WINDOWS // 2).collect()]
    field = Field()
    data = [example(w["text"], list(zip(w["starts"], w["ends"], strict=True)), field, file_features(w["text"])) for w in got]
    data += [example(t, s, field, file_features(t)) for t, s in made_lines()]
    field.train([d for d in data if d])
    return field


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_COLUMNS = (("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64()))


def scan(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    scanner = Scanner(field)

    def scanned(texts: list) -> pa.Array:
        rows = []
        for spans in scanner.spans(texts):
            kinds = [k for _, k, _ in spans]
            base = written([x for x in spans if x[1] < 3])
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), written(spans), kinds.count(3)))
        columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])

    shape = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,n_crf:bigint>"
    return pick(documents, "doc_id", "text").select("doc_id", over_texts(shape, scanned)("text").alias("s")).select("doc_id", "s.*")


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, fit(docs))
