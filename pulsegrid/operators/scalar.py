"""Projections: normalisation, durations, coordinates, sanitising, scaling, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.quantiles import exact_quantiles

PIXEL = ["recording_id", "pixel_id"]


def normalise(signals: DataFrame, frames: int = 16, low: float = 0.004, high: float = 0.996, guard: bool = True) -> DataFrame:
    """Clip to the percentiles of the first frames and scale to 0..255; a flat image gets a range of one if ``guard``."""
    bounds = exact_quantiles(signals.where(F.col("t") < frames), "recording_id", "v", [low, high]).select("recording_id", F.col("q").alias("p"))
    least, most = F.col("p")[0], F.col("p")[1]
    most = F.when(most <= least, least + 1).otherwise(most) if guard else most
    clipped = F.least(F.greatest("v", least), most)
    # one row for each recording
    return signals.join(bounds, "recording_id").withColumn("v", (clipped - least) / F.nullif(most - least, F.lit(0.0)) * 255).drop("p")


def duration(frames: Column, use_fps: Column, value: Column) -> Column:
    """Seconds of a recording: frames over the rate, or the stated duration."""
    return F.when(use_fps, frames / value).otherwise(value)


def coordinates(pixels: DataFrame, width: int) -> DataFrame:
    return pixels.withColumns({"y": F.floor(F.col("pixel_id") / width).cast("int"), "x": (F.col("pixel_id") % width).cast("int")})


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def sanitise(signals: DataFrame, most: float = 0.9) -> DataFrame:
    """Values that aren't finite become 0; a recording where over ``most`` of them aren't is an error."""
    # one row for each recording
    shares = signals.groupBy("recording_id").agg(F.avg((~finite(F.col("v"))).cast("double")).alias("share_"))
    checked = signals.join(F.broadcast(shares), "recording_id")
    value = F.when(F.col("share_") > most, F.raise_error(F.concat(F.lit("too few finite values in "), "recording_id")).cast("double")).when(finite(F.col("v")), F.col("v")).otherwise(0.0)
    return checked.withColumn("v", value).drop("share_")


def subtract_baseline(signals: DataFrame, baselines: DataFrame) -> DataFrame:
    """``baselines`` has a baseline for each pixel and frame."""
    return signals.join(baselines.select(*PIXEL, "t", "baseline"), [*PIXEL, "t"]).withColumn("v", F.col("v") - F.col("baseline")).drop("baseline")


def above_minimum(signals: DataFrame) -> DataFrame:
    """What is left where no baseline can be fitted: the signal above its least value."""
    return signals.withColumn("v", F.col("v") - F.min("v").over(Window.partitionBy(*PIXEL)))


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def _scaled(v: Column, least: float, norm) -> Column:
    """(v - mean) / norm, with a norm under ``least`` taken as one."""
    about = lambda mean: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return let(mean_of(v), lambda mean: let(norm(about(mean)), lambda n: F.transform(v, lambda x: (x - mean) / F.when(n < least, F.lit(1.0)).otherwise(n))))


def centred(v: Column) -> Column:
    """A packed signal about its mean, of length one; a flat one stays at zero."""
    return _scaled(v, 1e-10, F.sqrt)


def centre_l2(packed: DataFrame) -> DataFrame:
    return packed.withColumn("v", centred(F.col("v")))


def zscore(packed: DataFrame) -> DataFrame:
    """Population z-scores of each signal; a flat one stays at zero."""
    return packed.withColumn("v", _scaled(F.col("v"), 1e-10, lambda s: F.sqrt(s / F.size("v"))))


def standardise(features: DataFrame, columns: list[str], by: str = "recording_id") -> DataFrame:
    """Columns of a recording to zero mean and unit population variance; a column that doesn't vary, and what isn't finite, becomes 0."""
    stats = features.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: F.when(F.col(f"s_{c}") > 1e-10, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in columns}
    return features.join(stats, by).withColumns({c: F.when(finite(x), x).otherwise(0.0) for c, x in scaled.items()}).select(*features.columns)


def map_value(label: Column) -> Column:
    """A label's value on a map: 0 inactive (-2), 1 noise (-1), label + 2."""
    return F.when(label == -2, 0).when(label == -1, 1).otherwise(label + 2)


def label_map(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """All pixels with the label of those that have one, -2 otherwise, and its value on a map."""
    out = pixels.select(*PIXEL).join(labels.select(*PIXEL, "label"), PIXEL, "left").withColumn("label", F.coalesce("label", F.lit(-2)))
    return out.withColumn("map_value", map_value(F.col("label")))
