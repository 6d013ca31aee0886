"""Cutting a plan's lineage between the rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def _shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-rounds-"))
    return _own_dir[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; then the tables of earlier rounds that nothing reads any more are deleted.

    A table and not a checkpoint, which hands on what is known of the columns: that doubles from round to round where a round joins
    its own table.
    """
    spark = df.sparkSession
    path = shared_path(spark, "rounds")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rounds_path = path
    for old in spent:
        where = spark._jvm.org.apache.hadoop.fs.Path(old._rounds_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out
