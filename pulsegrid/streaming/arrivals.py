"""Recordings as their events arrive: running cells of the grid by event time, with late events within a bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import shared_path


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def cells(events: DataFrame, width: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Means of each pixel in windows of event time; a window is told once no event of it can come any more."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", width).alias("frame"), F.col("user_id").cast("int").alias("pixel_id"))
    return grouped.agg(F.avg("value").alias("v"), F.count("*").alias("n")).select("pixel_id", F.col("frame.start").alias("start"), "v", "n")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch of new rows to ``handle``; the checkpoint makes a restart go on where it was."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(stream: DataFrame) -> DataFrame:
    """The rows that a stream tells of all input there is now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
