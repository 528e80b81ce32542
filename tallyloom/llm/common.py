"""Helpers that every corpus operator shares: column picking, shared storage, hashed samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written

#: ASCII white space of the contracts, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Selects columns by exact name and position.

    Other columns may have any names, also ones that differ by case only or that
    operators use themselves; a missing column is an error that names it.
    """
    columns = df.columns
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return pick(df, *columns) if columns else df


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors.

    ``rows``: most rows of an Arrow batch while it is written, for plans with long texts or blocks; the session's own setting stands again afterwards.
    """
    if rows is None:
        return written(df, name)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def slices(batches, rows: int = 256):
    """Parts of Arrow batches. Spark bounds a batch to 64 MB; what Python makes of its texts is several times that, so it looks at few at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def over_texts(kind: str, f, rows: int = 256):
    """A column function of one text column: ``f`` maps a list of texts to an Arrow array, ``rows`` texts at a time."""
    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        parts = [f(text.slice(k, rows).to_pylist()) for k in range(0, len(text), rows)]
        return pa.concat_arrays(parts) if parts else f([])

    return run


def remainder(modulus: int, doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def hashed_ids(rows: DataFrame, limit: int, seed: int = 17) -> DataFrame:
    """At most ``limit`` distinct ids in the order of a hash: the bounded sample for fitting classifiers.

    Of many ids, only those below a cut of the hash that leaves somewhat more than ``limit`` go into the sort, so no
    task sorts more than about that.
    """
    ids = rows.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    order, n = F.xxhash64(F.col("doc_id"), F.lit(seed)), ids.count()
    if n > 2 * limit:
        share = int((1 << 40) * (limit / n) * (1 + 10 / limit**0.5))
        ids = ids.where(F.pmod(order, F.lit(1 << 40)) < share)
    return ids.orderBy(F.pmod(order, F.lit(1 << 40)), "doc_id").limit(limit)


#: Texts that a sample takes of one id, where rows share ids.
TEXTS_OF_AN_ID = 4


def sampled(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen ids, ``TEXTS_OF_AN_ID`` of each at most (in the order of a hash of the text), so that the sample of rows is bounded, too."""
    found = rows.join(F.broadcast(chosen), "doc_id").withColumn("__t", F.xxhash64("text"))
    found = found.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("__t")))
    return found.where(F.col("__n") <= TEXTS_OF_AN_ID).drop("__t", "__n")
