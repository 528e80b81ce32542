"""Benchmark decontamination as a prefix-filtered set join, with built-in functions only.

1. Benchmark items are cut into windows of ``WINDOW`` words (an item of fewer words is one
   window). 2. Words are ordered by rarity in the whole corpus: one pass counts those that occur
in windows. Containment must be whole, so one token is the necessary prefix of a window: its
rarest word. 3. A second pass looks each document word up among the prefix words, drops windows
that would leave the document (length and position bounds) and compares the rest exactly, word by
word, all inside the row and before anything is shuffled. 4. Only verified hits are shuffled.

Prefixes are broadcast if there are at most ``BLOCK`` windows (about 100 MB); a larger benchmark is taken in parts of
about that size by a hash of the prefix, with a pass each. The benchmark's words are broadcast for counting if they are at most ``VOCABULARY``;
beyond that all words of the corpus are counted (summed in each task before they are shuffled) and met by a join.

Edge cases: null and empty texts have no words, are never hit and keep their row; items without
words match nothing; equal items each count; an item without an id hits words but is not counted; repeated document rows each get a row (with equal
texts, equal results); columns beside those named may have any names; an empty benchmark leaves all clean. Results are exact, with no caps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, pick, table

WINDOW = 8
#: Bounds of what is broadcast: windows, and words of the benchmark.
BLOCK, VOCABULARY = 500_000, 1_000_000
#: What separates words once A-Z is lower-cased: ASCII other than digits and a-z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; null for none. Separators at the ends leave empty strings, removed here."""
    return F.array_remove(F.split(ascii_lower(text), BREAK), "")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, win (its words), for every window of every item."""
    items = pick(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    return items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.expr(f"slice(w, s, {width})").alias("win"))


def rarities(vocabulary: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, n) for each word of ``vocabulary`` that the corpus has."""
    seen = docs.select(F.explode(words(F.col("text"))).alias("word"))
    if vocabulary.count() <= VOCABULARY:
        return seen.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return seen.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")


def prefixed(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct windows that the corpus may have, with their prefix: win, token (the rarest word in the corpus), place (its first index from 0)."""
    distinct = wins.select("win").distinct()
    vocabulary = materialize(distinct.select(F.explode("win").alias("word")).distinct(), "benchmark-words")
    each = distinct.select("win", F.posexplode("win").alias("place", "word")).join(rarities(vocabulary, docs), "word", "left")
    rarest = each.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("m"))
    # A window with a word that the corpus lacks is nowhere.
    return rarest.where(F.col("m.n") > 0).select("win", F.col("m.word").alias("token"), F.col("m.place").alias("place"))


def _hits(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Verified occurrences: key columns, start (from 0), end, win."""
    each = docs.select(*KEY, words(F.col("text")).alias("w")).select(*KEY, "w", F.posexplode("w").alias("at", "token"))
    joined = each.join(F.broadcast(prefixes), "token")
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.size("win") <= F.size("w"))
    same = F.when(fits, F.slice("w", start + 1, F.size("win")) == F.col("win")).otherwise(False)
    return joined.where(same).select(*KEY, start.alias("start"), (start + F.size("win")).alias("end"), "win")


#: A document row: its id as text ('' for null, which no id is) and a hash of its text, since ids may repeat.
KEY = ["did", "row_hash"]


def covered(spans):
    """Words under sorted (start, end) spans; one that several cover counts once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and row_hash (of the text)."""
    docs = pick(documents, "doc_id", "text")
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), F.xxhash64("text").alias("row_hash"))
    wins = materialize(windows(benchmark, width), "benchmark-windows")
    prefixes = materialize(prefixed(wins, docs), "benchmark-prefixes")
    count = prefixes.count()
    counted = docs.select("doc_id", *KEY, F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"))
    if not count:
        nothing = F.array().cast("array<string>")
        out = counted.withColumns({"n_hit": F.lit(0).cast("long"), "items": nothing})
    else:
        parts = -(-count // BLOCK)
        part = F.pmod(F.xxhash64("token"), F.lit(parts))
        hits = reduce(DataFrame.unionByName, [_hits(docs, prefixes if parts == 1 else prefixes.where(part == k)) for k in range(parts)])
        items = wins.select("win", F.col("item_id").cast("string").alias("item")).distinct()
        named = hits.join(F.broadcast(items) if wins.count() <= BLOCK else items, "win")
        # What is gathered for a document is bounded by its own length and the items found in it.
        found = named.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
        found = found.select(*KEY, covered(F.col("spans")).alias("n_hit"), "items")
        out = counted.join(found, KEY, "left")
        out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_items = F.size("items").cast("long")
    return out.select(
        "doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_items >= least_items).alias("contaminated"), "row_hash")


def op7_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


ORACLE = r'''
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 7], ' ') AS win, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT p.rid, p.s, p.n, win.item_id FROM pos p JOIN win ON p.win = win.win AND p.n = win.n),
covered AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS k FROM hit) GROUP BY rid),
items AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM dw d LEFT JOIN covered c ON c.rid = d.rid LEFT JOIN items i ON i.rid = d.rid
'''


def clean(documents: DataFrame, benchmark: DataFrame, least_items: int = 1) -> DataFrame:
    """The documents that quote fewer than ``least_items`` items, with all their columns: by default any quoted window is enough to go."""
    tag = decontaminate(documents, benchmark, least_items=least_items).where("contaminated").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), "row_hash").distinct()
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumns({"did": F.coalesce(F.col(f"c{names.index('doc_id')}").cast("string"), F.lit("")), "row_hash": F.xxhash64(f"c{names.index('text')}")})
    return plain.join(tag, KEY, "left_anti").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
