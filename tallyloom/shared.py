"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder, removed at the end; a cluster must name one.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None or not Path(_own).is_dir():
        _own = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that several plans read, and reads it back: its plan runs once, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Most bytes, as shuffled, that partitions are joined up to inside ``divided``.
JOINED_BYTES = 16 << 20


@contextmanager
def divided(spark: SparkSession, tasks: int):
    """Plans that are run inside shuffle to ``tasks`` partitions at least and join no more than ``JOINED_BYTES``; the session's settings stand again afterwards.

    The session's own number of partitions is fixed, so that what a task sorts would grow with the input.
    """
    conf, size = spark.conf, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    number, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: conf.get(k) for k in (number, joined)}
    conf.set(number, str(max(tasks, int(before[number]))))
    conf.set(joined, str(min(JOINED_BYTES, size(before[joined]))))
    try:
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` returned and that no plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
