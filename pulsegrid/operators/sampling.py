"""Weighted samples of pixels, and the exports of chosen ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .activity import span
from .scalar import PIXEL

METRIC_ORDER = ["bpm", "amp", "f0", "t_on_ms", "t10_on", "t50_on", "t90_on", "t_off_ms", "t10_off", "t50_off", "t90_off", "cd"]
FIRST_COLUMNS = ["Filename", "ID", "X (Binned)", "Y (Binned)"]


def amplitudes(packed: DataFrame) -> DataFrame:
    """(pixel, weight): squared range of each signal."""
    return packed.select(*PIXEL, F.pow(span(F.col("v")), 2).alias("weight"))


def first_ranked(candidates: DataFrame, key: Column, k: int) -> DataFrame:
    """The ``k`` rows of each recording of the largest key, ties by pixel, with their ``rank``."""
    order = Window.partitionBy("recording_id").orderBy(key.desc(), "pixel_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def heaviest(candidates: DataFrame, k: int = 10) -> DataFrame:
    return first_ranked(candidates, F.round(F.col("weight"), 6), k)


def weighted_sample(candidates: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """``k`` pixels of each recording, drawn without replacement by weight: those of the largest log(u) / w.

    u comes from a digest of the pixel and the seed, so a lost task draws the same. Without any weight all are equally likely.
    """
    digest = F.md5(F.concat_ws("|", "recording_id", F.col("pixel_id").cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / (1 << 52)
    whole = candidates.groupBy("recording_id").agg((F.max("weight") > 0).alias("some_"))
    keyed = candidates.join(whole, "recording_id").withColumn("w_", F.when(F.col("some_"), F.col("weight")).otherwise(1.0)).drop("some_")
    keyed = keyed.withColumn("key_", F.when(F.col("w_") > 0, F.ln(u) / F.col("w_")).otherwise(F.lit(float("-inf"))))
    return first_ranked(keyed, F.col("key_"), k).drop("w_", "key_")


def labelled_sample(packed: DataFrame, labels: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """A weighted sample of pixels that are not inactive (label -1 or more), named P1, P2, ..."""
    drawn = weighted_sample(amplitudes(packed.join(labels.where("label >= -1").select(*PIXEL), PIXEL)), k, seed)
    return drawn.withColumn("point", F.concat(F.lit("P"), F.col("rank").cast("string")))


def metrics_sheet(kinetics: DataFrame) -> DataFrame:
    """The known metrics in their order, rounded half to even to three places."""
    return kinetics.select(*PIXEL, *[F.bround(c, 3).alias(c) for c in METRIC_ORDER if c in kinetics.columns])


def batch_columns(rows: DataFrame) -> DataFrame:
    """The identifying columns first, then the rest."""
    return rows.select(*[c for c in FIRST_COLUMNS if c in rows.columns], *[c for c in rows.columns if c not in FIRST_COLUMNS])


def cell_name(stem: Column, point: Column, y: Column, x: Column) -> Column:
    return F.format_string("%s_%s_Y%dX%d", stem, point, y, x)


def traces_sheet(traces: DataFrame, names: list[str]) -> DataFrame:
    """``traces`` (name, t, time_s, v) with a column for each of ``names`` over the frames of the first; shorter traces end in null, longer ones are cut.

    ``names`` are the chosen cells, a handful.
    """
    frames = traces.where(F.col("name") == names[0]).select("t", "time_s")
    pivoted = traces.where(F.col("name").isin(names)).groupBy("t").pivot("name", names).agg(F.last("v"))
    return frames.join(pivoted, "t", "left")
