"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is folded to lower-case letters with single spaces; n-grams of 1 to 3 characters are hashed to ``BUCKETS``
dimensions, weighted by log counts and by inverse document frequencies from *all* training documents, and scaled to unit length. The
weights are fitted by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample of
training rows, so that most stay exactly zero; a temperature, fitted on a part of the sample that the weights did not see,
calibrates the probabilities.

Edge cases: a null text or one without a letter is ``und`` with score 0; very short texts are scored on what they have; equal
scores go to the first language by name; without training rows all is ``und``; null ids are predicted but not learned from; repeated rows each get a row;
other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashed_ids, over_texts, pick, remainder, sampled, slices, table

BUCKETS, LONGEST = 1 << 14, 3
#: Bound of the sample that weights and temperature are fitted on.
SAMPLE = 3_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.002, 3
_other = re.compile(r"[\W\d_]+")
_letter = re.compile(r"[^\W\d_]")


def grams(text: str | None) -> np.ndarray | None:
    """Bucket of every n-gram of a text; None if it has no letter."""
    if not text or not _letter.search(text):
        return None
    folded = f" {_other.sub(' ', text.lower()).strip()} "
    c = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        mixed = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x2C1B)
        mixed = mixed * np.uint32(0x85EBCA6B)
        out.append((mixed >> np.uint32(32 - 14)).astype(np.int32))
    return np.concatenate(out)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(number of texts, texts with each bucket) over all rows of ``text``; one row for each task and bucket is shuffled."""
    def counted(batches):
        total, df = 0, np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                g = grams(t)
                if g is not None:
                    total += 1
                    df += np.bincount(g, minlength=BUCKETS) > 0
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(df[k], total))], names=["bucket", "n"])

    rows = texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(BUCKETS), 0
    for r in rows:  # BUCKETS + 1 rows at most
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return total, df


def vector(g: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(g, minlength=BUCKETS)
    k = np.flatnonzero(counts)
    v = np.log1p(counts[k]) * idf[k]
    norm = np.sqrt((v * v).sum())
    return k, v / norm if norm else v


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list, y: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (classes x buckets + 1); the last column is the intercept, without penalty."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(k):
        zk, nk = z[:, k], n[:, k]
        l1 = np.where(k == BUCKETS, 0.0, L1)
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((BETA + np.sqrt(nk)) / ALPHA + L2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            k, v = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(k)
            g = (softmax(w @ v) - (np.arange(classes) == y[i]))[:, None] * v
            s = (np.sqrt(n[:, k] + g * g) - np.sqrt(n[:, k])) / ALPHA
            z[:, k] += g - s * w
            n[:, k] += g * g
    return weights(np.arange(BUCKETS + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    # Targets of (n + 1) / (n + 2), not 1: a sample without errors is no proof of certainty.
    doubt, others = 1 / (len(y) + 2), max(1, logits.shape[1] - 1)

    def loss(t):
        logs = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))
        right = logs[np.arange(len(y)), y]
        return -((1 - doubt) * right + doubt * (logs.sum(1) - right) / others).mean()

    a, b, r = np.log(0.02), np.log(10.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, divisor: float):
        self.languages, self.idf, self.weights, self.divisor = languages, idf.astype(np.float32), weights.astype(np.float32), divisor

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if self.languages else None
        if g is None:
            return "und", 0.0
        k, v = vector(g, self.idf)
        p = softmax((self.weights[:, k] @ v + self.weights[:, -1]) / self.divisor)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows of (doc_id, text, lang) that the caller has limited to training rows.

    The sample is shared out by language: each of the languages that occur has an equal quota of it, so that a rare one is learned, too.
    """
    rows = pick(documents, "doc_id", "text", "lang").where(F.col("lang").isNotNull())
    total, df = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 0.1
    # A row a language: names of languages, of which there are few by nature; the sample's bound holds for any number.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    quota, chosen = quotas(counts, sample), None
    if sum(counts.values()) <= sample or len(counts) < 2:
        chosen = hashed_ids(rows, sample)
    else:
        order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 40))
        # Of each language somewhat more than its quota lies below its cut; the sort then takes no more than that.
        cut = F.create_map(*[F.lit(x) for lang, q in quota.items() for x in (lang, int(min(1.0, (q + 10 * q**0.5) / counts[lang]) * (1 << 40)))])
        most = F.create_map(*[F.lit(x) for lang, q in quota.items() for x in (lang, q)])
        ids = rows.where(F.col("doc_id").isNotNull() & (order < cut[F.col("lang")])).select("doc_id", "lang").distinct()
        place = F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id"))
        chosen = ids.withColumn("__n", place).where(F.col("__n") <= most[F.col("lang")]).select("doc_id").distinct()

    def folded(texts: list) -> pa.Array:
        found = [grams(t) for t in texts]
        return pa.array([None if g is None else vector_bytes(g, idf) for g in found], pa.binary())

    got = sampled(rows, chosen).select("doc_id", "lang", over_texts("binary", folded)("text").alias("x")).where(F.col("x").isNotNull()).collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return Model([], idf, np.zeros((0, BUCKETS + 1)), 1.0)
    x = []
    for r in got:
        pairs = np.frombuffer(bytes(r["x"]), np.dtype([("k", "<u2"), ("v", "<f4")]))
        x.append((pairs["k"].astype(np.int64), pairs["v"].astype(float)))
    y = np.array([languages.index(r["lang"]) for r in got])
    held = np.arange(len(x)) % 5 == 4
    w = ftrl([a for a, h in zip(x, held, strict=True) if not h], y[~held], len(languages))
    logits = np.array([w[:, a[0]] @ a[1] + w[:, -1] for a, h in zip(x, held, strict=True) if h]).reshape(-1, len(languages))
    return Model(languages, idf, w, temperature(logits, y[held]))


def vector_bytes(g: np.ndarray, idf: np.ndarray) -> bytes:
    k, v = vector(g, idf)
    out = np.empty(len(k), np.dtype([("k", "<u2"), ("v", "<f4")]))
    out["k"], out["v"] = k, v
    return out.tobytes()


def quotas(counts: dict, most: int) -> dict:
    """Shares of ``most`` for groups of these sizes: equal ones, and what small groups leave over goes to the others."""
    out, left = {}, most
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, left // (len(counts) - k))
        left -= out[name]
    return out


def predict(documents: DataFrame, model: Model) -> DataFrame:
    def predicted(texts: list) -> pa.Array:
        found = [model.predict(t) for t in texts]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["lang_pred", "score"])

    rows = pick(documents, "doc_id", "text").select("doc_id", (remainder(3) == 1).alias("held_out"), over_texts("struct<lang_pred:string,score:double>", predicted)("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, fit(docs.where(remainder(3) != 1)))
