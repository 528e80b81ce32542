"""Quality rules as a learned decision list.

Each text is profiled once (counts only). Sequential covering then grows threshold conjunctions
for the reject class on two thirds of a bounded sample of labelled rows, prunes each on the
other third, keeps it if it is precise there, removes what it covers and goes on. The list comes
out as ordered Spark conditional expressions over the profile columns; ``describe`` prints it.

Edge cases: a null, empty or blank text has all counts 0 and fails the base rule; ties between
conditions go to the earlier feature and lower threshold; without labels (or with one class) the list is
empty and the base rule decides alone; of an id with several labels the smallest counts, null ids and labels are not learned from; repeated rows each get a row;
other columns may have any names; texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_ids, over_texts, pick, sampled, table

#: Bound of the labelled sample that the list is fitted on.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
REPEAT = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_adjacent", "n_distinct", "n_tagged")
_split = re.compile(r"[^\x20\x09-\x0D]+").findall
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_tagged = re.compile(r"[^\x20\x09-\x0D][#*$%&|<>!]{2,}(?![^\x20\x09-\x0D])").findall


def repeated_words(words: list[str], width: int = REPEAT) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    if len(ids) == n:
        return 0
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - width + 1 + k]
    _, inverse, count = np.unique(rolled, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    if not len(again):
        return 0
    # Equal hashes are only candidates: the windows themselves are compared.
    seen: dict[tuple, int] = {}
    listed = codes.tolist()
    windows = [tuple(listed[i : i + width]) for i in again.tolist()]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    edge = np.zeros(n + 1, np.int64)
    for i, w in zip(again.tolist(), windows, strict=True):
        if seen[w] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def profile(text: str | None) -> tuple:
    """The counts of ``COUNTS`` for one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = _split(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    spaces = sum(map(text.count, SPACES))
    return (
        len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(_upper(text)), len(text) - spaces - sum(map(text.count, "0123456789.,;:!?'\"()-")), text.count("!"),
        sum(a == b for a, b in zip(words, words[1:], strict=False)), len(set(words)), len(_tagged(text)),
    )


def _profiles(texts: list) -> pa.Array:
    columns = list(zip(*map(profile, texts), strict=True)) or [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def _profile_udf():
    return over_texts("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">", _profiles)


#: The column of counts beside a table's own, which go by numbers meanwhile.
PROFILE = "profile"

#: Features of the rules: a numerator and a denominator count, or a count alone.
FEATURES = {
    "symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
    "upper_ratio": ("n_upper", "n_letters"), "mark_ratio": ("n_marks", "n_words"), "adjacent_ratio": ("n_adjacent", "n_words"),
    "distinct_ratio": ("n_distinct", "n_words"), "tagged_ratio": ("n_tagged", "n_words"), "word_length": ("word_chars", "n_words"),
    "n_words": ("n_words", None), "n_lines": ("n_lines", None),
}


def feature(name: str, at: str = PROFILE) -> Column:
    top, bottom = FEATURES[name]
    value = F.col(f"{at}.{top}").cast("double")
    return value if bottom is None else value / F.greatest(F.col(f"{at}.{bottom}"), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which all (feature, at_least, threshold) hold."""

    conditions: tuple

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, at_least, t in self.conditions:
            v = x[:, names.index(f)]
            out &= (v >= t) if at_least else (v <= t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, at_least, t in self.conditions:
            out = out & ((feature(f) >= t) if at_least else (feature(f) <= t))
        return out

    def describe(self) -> str:
        return " and ".join(f"{f} {'>=' if g else '<='} {t:.6g}" for f, g, t in self.conditions)


def learn(x: np.ndarray, reject: np.ndarray, fold: np.ndarray, names: list[str], precision: float = 0.98, most_conditions: int = 3, most_rules: int = 12, least: int = 8) -> list[Rule]:
    """Sequential covering: grow by FOIL gain where ``fold`` is not 0, prune and accept where it is 0."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules:
        grow, prune = left & (fold != 0), left & (fold == 0)
        covered, conditions = grow.copy(), []
        while len(conditions) < most_conditions:
            p0, n0 = int((covered & reject).sum()), int((covered & ~reject).sum())
            if p0 < least or n0 == 0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None, None)
            for k, f in enumerate(names):
                values = x[covered, k]
                y = reject[covered]
                # Cuts lie between values: midpoints around quantiles of the class sought, and of the other.
                marks = np.unique(np.concatenate((np.quantile(values[y], np.linspace(0, 1, 33)), np.quantile(values[~y], np.linspace(0, 1, 33)))))
                for t in (marks[1:] + marks[:-1]) / 2:
                    for at_least in (True, False):
                        hit = values >= t if at_least else values <= t
                        p, n = int((hit & y).sum()), int((hit & ~y).sum())
                        if p >= least and (gain := p * (np.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                            best = (gain, (f, at_least, float(t)), None)
            if best[1] is None:
                break
            conditions.append(best[1])
            covered = grow & Rule(tuple(conditions)).holds(x, names)
        if not conditions:
            break

        def worth(rule: Rule) -> float:
            hit = prune & rule.holds(x, names)  # noqa: B023
            p, n = (hit & reject).sum(), (hit & ~reject).sum()
            return (p - n) / max(1, p + n)

        options = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        rule = max(options, key=lambda r: (worth(r), -len(r.conditions)))
        whole = left & rule.holds(x, names)
        held = prune & rule.holds(x, names)
        p, n = int((held & reject).sum()), int((held & ~reject).sum())
        if p + n == 0 or p < precision * (p + n) or (whole & reject).sum() < precision * whole.sum():
            # Not precise enough to reject by: what it would cover is set aside, and the search goes on.
            if not (whole & reject).any() or len(rules) + 1 >= most_rules:
                break
            left &= ~(whole & reject)
            most_rules -= 1
            continue
        rules.append(rule)
        left &= ~whole
    return rules


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learns the list from at most ``sample`` labelled documents; only their counts come to the driver."""
    docs, marks = pick(documents, "doc_id", "text"), pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marks.join(hashed_ids(marks, sample), "doc_id", "left_semi")
    rows = sampled(docs, chosen).select(F.col("doc_id").cast("string").alias("id"), "quality", _profile_udf()(F.col("text")).alias("p"))
    got = rows.select("id", "quality", "p.*").toPandas()
    if not len(got):
        return []
    got = got.sort_values(list(got.columns), ignore_index=True)
    names = list(FEATURES)
    x = np.stack([got[a] / np.maximum(got[b], 1) if b else got[a] for a, b in FEATURES.values()], 1).astype(float)
    fold = np.array([zlib.crc32(f"quality:{d}".encode()) % 3 for d in got["id"]])
    usable = (got["n_words"] >= 20).to_numpy()  # the base rule has the others
    reject = (got["quality"] == 0).to_numpy()
    return learn(x[usable], reject[usable], fold[usable], names)


def _judged(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """Columns of documents by number (c0, c1, ...), then ``profile``, ``base_failed``, ``rule`` (the one that fired) and ``kept``."""
    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    rows = plain.withColumn(PROFILE, _profile_udf()(F.col(f"c{documents.columns.index('text')}")))
    failed = (F.col(f"{PROFILE}.n_words") < 20) | (100 * F.col(f"{PROFILE}.n_repeat_words") > 30 * F.col(f"{PROFILE}.n_words"))
    fired = F.lit(None).cast("string")
    for r in reversed(rules):
        fired = F.when(r.column(), F.lit(r.describe())).otherwise(fired)
    rows = rows.withColumn("base_failed", failed).withColumn("rule", F.when(~F.col("base_failed"), fired))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts of ``COUNTS``, base_failed, kept, and rule (the one that fired)."""
    rows = _judged(documents, rules)
    return rows.select(F.col(f"c{documents.columns.index('doc_id')}").alias("doc_id"), *[F.col(f"{PROFILE}.{c}").alias(c) for c in COUNTS], "base_failed", "kept", "rule")


def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")


def good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns, whatever these are called."""
    rows = _judged(documents, fit(documents, labels)).where("kept")
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(documents.columns)])
