"""New transcript files as a stream. A file is parsed whole when it first appears; edited files need a batch scan of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import transcripts

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime, size and content of each new file."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl}").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def parse_to(files: DataFrame, table: str, checkpoint: str, source: str | None = None, matchers: str | None = None, once: bool = False):
    """Parses each micro-batch of files into a Parquet table (schema ``PARSED`` and the batch's number).

    A batch that is run again after a failure overwrites its own folder, so each file is there exactly once.
    """
    def put(batch: DataFrame, number: int) -> None:
        transcripts.parsed(batch, source, matchers).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def token_rates(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Events and output tokens by event-time window and type, for streams and tables alike; late rows beyond ``late`` are dropped."""
    rows = events.withWatermark("ts", late).withColumn("tokens", F.floor(F.col("value") * 100).cast("long"))
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select("w.start", "event_type", "n", "tokens")
