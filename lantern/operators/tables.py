"""Intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this driver has made.
_MADE: list[str] = []


def drop_kept(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this driver has made, once results that read them are written. How many."""
    dropped = 0
    while _MADE:
        at = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        dropped += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return dropped


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only a local session without that
    setting uses a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="lantern-")
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def kept(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that lineage ends and nothing is lost with an executor."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows in as many partitions as shuffles have, by columns or in turn. Small files whose rows take long would be the work
    of one task; a number that is asked for isn't joined up again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shuffled(df: DataFrame) -> DataFrame:
    """df for joins that shuffle it. Spark broadcasts what it takes to be small by the size of the files that it comes from;
    rows that are exploded, or compressed well there, are many times that size in the driver."""
    return df.hint("merge")
