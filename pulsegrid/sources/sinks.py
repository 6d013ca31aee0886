"""Tables on disk that a retry leaves as they are: each write replaces the partitions that it has rows of, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECARS = "path string, content string, bucket int"


def overwrite(rows: DataFrame, path: str, by: str, format_: str = "parquet") -> None:
    """Write ``rows``, a folder for each value of ``by``; folders of other values stay. The rows of a value must come in one write.

    Rows of a value are dealt out by a few salts, so that a large one isn't one task's and a small one is a few files.
    """
    salted = rows.repartition(F.col(by), F.pmod(F.hash(*[c for c in rows.columns if c != by]), F.lit(4)))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(format_).save(path)


def read(spark: SparkSession, path: str, schema, format_: str = "parquet") -> DataFrame:
    """What was written; with its schema, so that names like 007 stay text."""
    return spark.read.format(format_).schema(schema).load(path)


def save_sidecars(sidecars: DataFrame, path: str, buckets: int = 16) -> None:
    """Sidecars (path, content) as JSON lines in folders by a hash of the path."""
    overwrite(sidecars.select("path", "content", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")), path, "bucket", "json")


def load_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all sidecars, for the chain of frame rates."""
    return read(spark, path, SIDECARS, "json").select("path", "content")
