"""Mixing sources to target weights, with built-in functions only.

Every document gets a hash-random key. Within its source the keys are cut into equal
ranges (as many as keep a range near ``RANGE_ROWS`` documents), so a range is a small sort
wherever a third of all rows has one source; token counts are prefix-summed over ranges
first, then inside each range. A document's prefix then says how much of it falls below
the source's exact budget: whole epochs first, the rest of the budget cut in key order.

Edge cases: a null text or one without words has size 0 and takes 0; a null source is a
source of its own, last in order; repeated rows are documents of their own (equal rows have
equal keys, and which of them comes first makes no difference to the result as a whole);
null ids share one key and are ordered by size and text; other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, materialize, pick

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE_ROWS = 4_000
KEYS = 1 << 32


def word_count(text: Column) -> Column:
    """Words of a text: places where a non-space follows a space or the beginning."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """32 bits of the MD5 of seed and id: the same in every run and on every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """From (source, source_size): target, by water-filling in closed form.

    A source stops at ``most`` times its size. With sources ordered by cap per weight, the
    level that the others share rises as caps are met, so a source is capped exactly if its cap
    per weight is below the level left when all before it are capped. Null target only for no rows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    # Past the first source that is not capped the level only falls, so the shared one is the largest.
    rows = rows.withColumn("shared", F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy()))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 8) -> DataFrame:
    """doc_id, size, source_size, target, taken, row_hash (of the text, to tell rows of one id apart)."""
    docs = pick(documents, "doc_id", "text", "source")
    hashed = F.xxhash64("text")
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), hashed.alias("row_hash"),
        random_key(F.col("doc_id"), seed).alias("key"),
    )
    sized = materialize(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    plan = per_source.select(F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("long").alias("ranges"))
    plan = plan.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    plan = materialize(plan, "mix-plan").withColumnRenamed("source", "s")

    ranged = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranged = ranged.withColumn("range", F.floor(F.col("key") * F.col("ranges") / KEYS))
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("base"))
    placed = ranged.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")

    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    taken = (epochs * F.col("size") + part).cast("long")
    return placed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "row_hash")


def op8_mix_sources(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents")).drop("row_hash")


ORACLE = r'''
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN cap < level * weight THEN cap
         ELSE max(CASE WHEN NOT cap < level * weight THEN level END) OVER () * weight END AS target
  FROM levels),
budgets AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM targets),
placed AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sized d)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(CASE WHEN b.source_size > 0 THEN (b.budget // b.source_size) * p.size
            + greatest(0, least(p.size, b.budget - (b.budget // b.source_size) * b.source_size - p.ahead)) ELSE 0 END AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
'''


def copies(documents: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its taken words say, a cut one if at least half is taken."""
    tag = F.xxhash64("text")
    plan = mix(documents).where(F.col("taken") > 0)
    plan = plan.groupBy(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__h")).agg(
        F.max(F.floor(F.col("taken") / F.col("size")) + F.when(2 * (F.col("taken") % F.col("size")) >= F.col("size"), 1).otherwise(0)).cast("int").alias("__n"))
    plan = plan.where(F.col("__n") > 0)
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    text, doc = F.col(f"c{names.index('text')}"), F.col(f"c{names.index('doc_id')}")
    tagged = plain.withColumn("__tag", F.xxhash64(text))
    joined = tagged.join(plan, doc.eqNullSafe(F.col("__d")) & (F.col("__tag") == F.col("__h")))
    each = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return each.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
