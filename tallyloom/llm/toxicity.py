"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a string of word classes (insult in three strengths, threat, target, negation, coordinator, reporting word, other,
comma, clause end). A transducer that reads a clause from its end marks what has a target after it; three more - negation scope, reported
speech, target before - are composed into one that reads it from its beginning. They rewrite the classes of each clause that has an insult or
threat into *matches*: targeted or plain, negated or reported. An insult may have its target on either side ("you fool", "a fool like you"); a
threat has it after ("kill you"), since a pronoun before it is who threatens. Negation reaches over coordinated insults ("not a fool or
loser") and ends at a comma. Matched clauses, not isolated words, carry weights: a logistic model over match counts, fitted on labelled rows,
gives arc weights and a probability.

The terminals (words and stems of insults) start from a fixed list and are learned from labelled rows: a term must be
frequent in toxic texts, rare in others, and stand among many different neighbours (so that the words of one text with many copies
do not count). The fit uses the rows of at most ``SAMPLE`` labelled ids (``common.sampled`` bounds rows that share one); every text is scored whole.

Edge cases: null, empty and wordless texts have no match and get the probability of a text without matches; repeated rows each
get a row; of an id with several labels the largest counts; null ids and labels are not learned from; columns beside doc_id and text may have any names;
without labels of both classes the fixed list has weight alone (prior weights); an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_ids, materialize, over_texts, pick, remainder, sampled, slices, table

#: Bound of the labelled sample for terms and weights, in ids.
SAMPLE = 20_000
#: Lengths of stems, longest first.
STEMS = (8, 7, 6, 5, 4)
#: Fixed word lists of the grammar's classes.
INSULTS = "idiot idiots moron morons stupid dumb fool loser losers pathetic scum trash worthless disgusting clown imbecile vermin filth".split()
THREATS = "kill hurt destroy murder beat burn strangle stab punish töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours u he she they them his her their these those du dich dein ihr sie tu toi vous ton votre ils elles tú usted ustedes vosotros ellos".split()
NEGATIONS = "not no never nobody isn't aren't don't won't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes claims claimed called quoted sagte sagt schrieb dit écrit dijo dice escribió".split()
COORDINATORS = "or nor and oder noch und ou ni et o y e".split()
CLAUSE_END = ".!?;:"
#: Outputs of the composed transducer, and prior weights for use without labels.
MATCHES = "ABCDIJKTijktpq"
PRIOR = dict(zip(MATCHES, (3.0, 2.0, 1.5, 2.5, 2.0, 1.5, 1.0, 0.5, 0.2, 0.1, 0.1, 0.1, 0.3, 0.2), strict=True))
NEGATION_SCOPE = 3


class Transducer:
    """Sequential transducer: (state, symbol) -> (state, symbol). Symbols that a state doesn't name pass unchanged."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.arcs.get((state, None), (state, None))[0], symbol)

    def then(self, other: Transducer, alphabet: str) -> Transducer:
        """Composition: what this one writes, ``other`` reads. All arcs of reachable states are made explicit."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            a, b = todo.pop()
            for symbol in alphabet:
                a2, written = self.step(a, symbol)
                b2, out = other.step(b, written)
                arcs[(a, b), symbol] = ((a2, b2), out)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)

    def run(self, symbols: str) -> str:
        state, out = self.start, []
        for s in symbols:
            state, w = self.step(state, s)
            out.append(w)
        return "".join(out)


#: What the first pass makes of insults and threats that have a target after them.
AHEAD = dict(zip("IJKT", "EFGH", strict=True))
ALPHABET = "oIJKTYNRC,"


def looking_ahead() -> Transducer:
    """Reads a clause from its end: after a target, insults and threats are marked."""
    return Transducer(0, {(s, "Y"): (1, "Y") for s in (0, 1)} | {(1, x): (1, y) for x, y in AHEAD.items()})


def grammar() -> Transducer:
    """Reads what ``looking_ahead`` wrote, from the beginning: negation, then reported speech, then target before."""
    low = dict(zip("IJKTEFGH", "ijktijkt", strict=True))
    spoken = {x: "q" if x in "THt" else "p" for x in "IJKTEFGHijkt"}
    aimed = dict(zip("IJKEFGH", "ABCABCD", strict=True))
    # States: how many more words the negation reaches; -1 right after a negated word, where a coordinator renews it.
    negation = {}
    for left in range(-1, NEGATION_SCOPE + 1):
        negation[left, "N"] = (NEGATION_SCOPE, "o")
        negation[left, ","] = (0, ",")
        negation[left, "C"] = (NEGATION_SCOPE if left == -1 else max(0, left - 1), "o")
        negation[left, None] = (max(0, left - 1), None)
        for symbol, lower in low.items():
            negation[left, symbol] = (-1, lower) if left > 0 else (0, symbol)
    report = {(s, "R"): (1, "o") for s in (0, 1)} | {(1, x): (1, y) for x, y in spoken.items()}
    target = {(s, "Y"): (1, "o") for s in (0, 1)} | {(1, x): (1, y) for x, y in aimed.items()} | {(0, x): (0, aimed[x]) for x in "EFGH"}
    alphabet = ALPHABET + "EFGH"
    return Transducer(0, negation).then(Transducer(0, report), alphabet).then(Transducer(0, target), alphabet)


class Grammar:
    """Both passes over a clause."""

    def __init__(self):
        self.ahead, self.main = looking_ahead(), grammar()

    def run(self, clause: str) -> str:
        return self.main.run(self.ahead.run(clause[::-1])[::-1])


_words = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?").findall


class Classes(dict):
    """Chunk of a text -> its symbols, worked out once for each chunk that a worker meets."""

    def __init__(self, words: dict[str, str], stems: dict[str, str]):
        self.words, self.stems = words, stems

    def __missing__(self, chunk: str) -> str:
        if len(self) > 300_000:
            self.clear()
        out = ""
        for w in _words(chunk):
            s = self.words.get(w)
            if s is None:
                s = next((self.stems[w[:k]] for k in STEMS if len(w) > k and w[:k] in self.stems), "o")
            out += s
        if chunk[-1] in CLAUSE_END:
            out += "."
        elif chunk[-1] == ",":
            out += ","
        self[chunk] = out
        return out


def lexicon(insults: dict[str, str] = {}) -> tuple[dict, dict]:
    """(words, stems) with their classes; learned terms (stems end in *) come over the fixed ones."""
    words = {w: "K" for w in INSULTS} | {w: "T" for w in THREATS} | {w: "Y" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS} | {w: "C" for w in COORDINATORS}
    words |= {t: c for t, c in insults.items() if not t.endswith("*")}
    return words, {t[:-1]: c for t, c in insults.items() if t.endswith("*")}


def matches(text: str | None, classes: Classes, machine: Grammar) -> tuple[list[int], int]:
    """Counts of ``MATCHES`` over the clauses of a text, and its number of words."""
    counts = [0] * len(MATCHES)
    if not text:
        return counts, 0
    # A line's end is a clause's end.
    symbols = ".".join(["".join([classes[c] for c in line.split()]) for line in text.lower().split("\n")])
    if any(x in symbols for x in "IJKT"):
        for clause in symbols.split("."):
            if any(x in clause for x in "IJKT"):
                out = machine.run(clause)
                for k, m in enumerate(MATCHES):
                    counts[k] += out.count(m)
    return counts, len(symbols) - symbols.count(".") - symbols.count(",")


def features(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of counts (rows x matches): their logs, whether any, and any for each 100 words."""
    total = counts.sum(1, keepdims=True)
    return np.hstack((np.log1p(counts), total > 0, np.minimum(100 * total / np.maximum(words[:, None], 1), 20) / 10)).astype(float)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept, which has no penalty."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def prior_weights() -> np.ndarray:
    return np.array([*PRIOR.values(), 1.0, 0.5, -3.0])


def _terms(text: str) -> dict[str, int]:
    """Words of a text with a hash of a left neighbour each, and their stems (with *) with a hash of the word."""
    found: dict[str, int] = {}
    before = ""
    for w in _words(text.lower()):
        near = hash_of(before)
        found.setdefault(w, near)
        for k in STEMS:
            if len(w) > k:
                found.setdefault(w[:k] + "*", hash_of(w))
        before = w
    return found


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "replace"))


def learn_terms(rows: DataFrame, least: int = 5, lift: float = 25.0) -> dict[str, str]:
    """Insult terms from labelled rows (doc_id, text, toxic)."""
    # Copies of a text count once.
    rows = rows.where(F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))

    n_toxic, n_other = rows.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    if not n_toxic or not n_other:
        return {}

    def toxic_terms(batches):
        for batch in slices(batches):
            terms, near = [], []
            for t in batch.column(0).to_pylist():
                found = _terms(t)
                terms += found
                near += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(near, pa.int64())], names=["term", "near"])

    toxic, other = rows.where("toxic = 1").select("text"), rows.where("toxic = 0").select("text")
    common = toxic.mapInArrow(toxic_terms, "term string, near long").groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("near").alias("kinds"))
    common = materialize(common.where((F.col("n") >= least) & (F.col("kinds") >= F.greatest(F.lit(4), F.least(F.lit(least), F.col("n") / 8)))), "toxic-terms")
    # What the sample's toxic texts share: the sample bounds it.
    names = frozenset(r["term"] for r in common.select("term").collect())

    def other_terms(batches):
        from collections import Counter

        seen = Counter()
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                seen.update(names.intersection(_terms(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "m"])

    others = other.mapInArrow(other_terms, "term string, m long").groupBy("term").agg(F.sum("m").alias("m"))
    ratio = (F.col("n") / n_toxic) / ((F.coalesce("m", F.lit(0)) + 0.5) / n_other)
    # Weaker terms need more support.
    kept = common.join(others, "term", "left").withColumn("ratio", ratio).where((F.col("ratio") >= lift) | ((F.col("ratio") >= lift / 2.5) & (F.col("n") >= 3 * least)))
    return {r["term"]: "I" if r["ratio"] >= 4 * lift else "J" if r["ratio"] >= lift else "K" for r in kept.collect()}


class Model:
    """Terms and weights; picklable, for executors."""

    def __init__(self, terms: dict[str, str], weights: np.ndarray | None = None):
        self.terms, self.weights = terms, weights

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_ready"):
            self._ready = (Classes(*lexicon(self.terms)), Grammar())
        found = [matches(t, *self._ready) for t in texts]
        return np.array([c for c, _ in found], float).reshape(-1, len(MATCHES)), np.array([n for _, n in found], float)

    def scores(self, texts) -> np.ndarray:
        counts, words = self.counts(texts)
        x = features(counts, words)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights}


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the rows of at most ``sample`` labelled ids that are not held out."""
    docs, marks = pick(documents, "doc_id", "text"), pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder(4) != 2)
    chosen = marks.join(hashed_ids(marks, sample), "doc_id", "left_semi")
    rows = materialize(sampled(docs, chosen), "toxic-sample")
    model = Model(learn_terms(rows))

    def counted(texts: list) -> pa.Array:
        counts, words = model.counts(texts)
        return pa.array(np.hstack((counts, words[:, None])).tolist(), pa.list_(pa.float64()))

    got = rows.select("toxic", over_texts("array<double>", counted)("text").alias("x")).collect()
    y = np.array([r["toxic"] for r in got], float)
    if len(got) < 20 or y.min() == y.max():
        model.weights = prior_weights()
    else:
        x = np.array([r["x"] for r in got])
        model.weights = fit_weights(features(x[:, :-1], x[:, -1]), y)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    scored = over_texts("double", lambda texts: pa.array(model.scores(texts), pa.float64()))
    return pick(documents, "doc_id", "text").select("doc_id", (remainder(4) == 2).alias("held_out"), scored("text").alias("score"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
