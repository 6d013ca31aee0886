"""The virtual recording: a signal grid built from the events table, and the packed form that operators read.

Signals are rows (recording_id, pixel_id, t, time_s, v); packed signals have one row for each pixel with an array of its values in
frame order. A pixel is a user, a frame half a day, a value the mean of the user's events in it and 0 without any. A mean's sum goes event
by event in the order of their ids (of their times where the table has no ids), so it is the same however the input is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


@dataclass(frozen=True)
class Grid:
    width: int = 15
    frames: int = 60
    duration: float = 6.0

    @property
    def fps(self) -> float:
        """Frames per second as the reference counts them; the step of the time axis is another, see ``time_s``."""
        return self.frames / self.duration


@dataclass(frozen=True)
class Params:
    """An analysis' parameters with their defaults; ``sigma`` of the blur is the frame's height over 204.8 unless stated, ``tile`` a multiple of ``bin_size``."""

    bin_size: int = 16
    model: str = "Single Exp"
    use_fps: bool = True
    value: float = 15.0
    epochs: int = 100
    batch_samples: int = 10
    sigma: float | None = None
    tile: int = 256

    def duration(self, frames: int) -> float:
        """Seconds of a recording: frames over the rate, or the stated duration."""
        return frames / self.value if self.use_fps else self.value


GRID = Grid()


def signals(spark: SparkSession, sf_dir: str, grid: Grid = GRID, by_type: bool = False) -> DataFrame:
    """The grid of all events, or a recording for each event type."""
    return unpack(packed(spark, sf_dir, grid, by_type), grid)


def pack(signals: DataFrame, value: str = "v") -> DataFrame:
    """(recording_id, pixel_id, v): values in frame order."""
    ordered = F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("x"))))
    return signals.groupBy("recording_id", "pixel_id").agg(F.transform(ordered, lambda s: s["x"]).alias("v"))


def unpack(packed: DataFrame, grid: Grid = GRID, value: str = "v") -> DataFrame:
    """Back to one row for each frame."""
    long = packed.select("recording_id", "pixel_id", F.posexplode(value).alias("t", "v"))
    return long.select("recording_id", "pixel_id", "t", (F.col("t") * grid.duration / (grid.frames - 1)).alias("time_s"), "v")


def in_frames(means: Column, frames: int) -> Column:
    """``means`` (t, v) as an array with a place for each frame, 0 in frames without a value."""

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def run(t: pa.Array, v: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(t)), t.value_lengths().to_numpy(zero_copy_only=False))
        frame = t.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        inside = (frame >= 0) & (frame < frames)
        out = np.zeros(len(t) * frames)
        out[row[inside] * frames + frame[inside]] = v.flatten().fill_null(0).to_numpy(zero_copy_only=False)[inside]
        return pa.ListArray.from_arrays(np.arange(0, len(out) + 1, frames, dtype=np.int32), out)

    return run(means["t"], means["v"])


def packed(spark: SparkSession, sf_dir: str, grid: Grid = GRID, by_type: bool = False) -> DataFrame:
    """The same grid, packed. Events are dealt out by pixel once, so neither the means nor the arrays shuffle again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    half_days = (F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 2 + (F.hour("ts") >= 12).cast("int")).cast("int")
    rec = F.col("event_type") if by_type else F.lit("events")
    # sums go event by event and not as tasks happen to end: with other last digits, frames of one height are no plateau or no equal peaks
    order = [c for c in ("event_id", "ts", "value") if c in events.columns]
    told = events.select(rec.alias("recording_id"), F.col("user_id").cast("int").alias("pixel_id"), half_days.alias("t"), *order)
    frame = Window.partitionBy("recording_id", "pixel_id", "t").orderBy(*order)
    sums = told.repartition("recording_id", "pixel_id").withColumns({"v": F.avg("value").over(frame.rowsBetween(Window.unboundedPreceding, 0)), "left": F.lead(F.lit(1)).over(frame)})
    means = sums.where(F.col("left").isNull()).groupBy("recording_id", "pixel_id").agg(F.collect_list(F.struct("t", "v")).alias("means"))
    return means.select("recording_id", "pixel_id", in_frames(F.col("means"), grid.frames).alias("v"))


def auto_bin(height: Column, width: Column) -> Column:
    """The bin size that suits a frame: 16 below 2048 pixels on the longer side, else 32."""
    return F.when(F.greatest(height, width) < 2048, 16).otherwise(32)


def likely_duration(seconds: Column) -> Column:
    """Whether a recording's length is one to run an analysis on unasked: between a second and five minutes."""
    return F.coalesce(seconds.between(1, 300), F.lit(False))
