"""Pulsatility, active pixels, reference trace, beats, activation delay, synchronicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import first_where, let, part, time_at_level, time_of
from ..functions.peaks import keep_apart, local_maxima, prominences, prominent
from ..functions.quantiles import exact_quantiles
from .scalar import PIXEL, centred


def pulsatility(signals: DataFrame) -> DataFrame:
    """Population variance of each pixel."""
    return signals.groupBy(*PIXEL).agg(F.var_pop("v").alias("pulsatility"))


def otsu_thresholds(maps: DataFrame, bins: int = 256) -> DataFrame:
    """(recording_id, low, high, p65, otsu): the histogram threshold that separates two classes best, at the middle of a bin."""
    bounds = exact_quantiles(maps, "recording_id", "pulsatility", [0.65]).select("recording_id", "low", "high", F.col("q")[0].alias("p65"))
    step = F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) / bins
    bin_of = F.least(F.floor((F.col("pulsatility") - F.col("low")) / step), F.lit(bins - 1)).cast("int")
    counts = maps.join(bounds, "recording_id").groupBy("recording_id", bin_of.alias("bin"), (F.col("low") + (bin_of + 0.5) * step).alias("centre")).agg(F.count("*").alias("n"))
    # empty bins never win alone: a run of them repeats the value of the bin before, which comes first
    up = Window.partitionBy("recording_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("recording_id").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    weighed = F.col("n") * F.col("centre")
    sums = counts.select("recording_id", "bin", "centre", F.sum("n").over(up).alias("w1"), F.sum("n").over(down).alias("w2"), F.sum(weighed).over(up).alias("s1"), F.sum(weighed).over(down).alias("s2"))
    between = F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2"), 2)
    best = sums.where("w2 > 0").groupBy("recording_id").agg(F.max_by("centre", F.struct(F.round(between, 9), -F.col("bin"))).alias("otsu"))
    return bounds.join(best, "recording_id", "left")


def activity_mask(maps: DataFrame) -> DataFrame:
    """``active`` for each pixel: above Otsu's threshold, or above the 65th percentile where that marks under 3 % or over 85 %, or the map is flat."""
    thresholds = otsu_thresholds(maps)
    marked = maps.join(thresholds, "recording_id")
    share = marked.groupBy("recording_id").agg(F.avg((F.col("pulsatility") > F.col("otsu")).cast("double")).alias("share"))
    plain = (F.col("high") - F.col("low") < 1e-10) | F.col("otsu").isNull() | (F.col("share") < 0.03) | (F.col("share") > 0.85)
    return marked.join(share, "recording_id").select(*PIXEL, "pulsatility", (F.col("pulsatility") > F.when(plain, F.col("p65")).otherwise(F.col("otsu"))).alias("active"))


def reference_trace(signals: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean of the active pixels in each frame, of all pixels where none is active."""
    marked = signals.join(mask.select(*PIXEL, "active"), PIXEL)
    return marked.groupBy("recording_id", "t", "time_s").agg(F.coalesce(F.avg(F.when(F.col("active"), F.col("v"))), F.avg("v")).alias("v"))


def span(v: Column) -> Column:
    return F.array_max(v) - F.array_min(v)


def beats(trace: DataFrame, fps: float) -> DataFrame:
    """(recording_id, beats): frames of the peaks of the reference trace, 0.8 s apart or more, of a prominence of 15 % of its range; none in a flat trace."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))
    packed = trace.groupBy("recording_id").agg(F.transform(ordered, lambda s: s["v"]).alias("v"))
    packed = packed.withColumn("apart", keep_apart(F.col("v"), local_maxima(F.col("v")), max(int(fps * 0.8), 2)))
    found = F.when(span(F.col("v")) < 1e-6, F.array().cast("array<int>")).otherwise(F.transform(prominent(F.col("v"), F.col("apart")), lambda e: e["p"]))
    return packed.select("recording_id", found.alias("beats"))


def peak_prominences(packed: DataFrame) -> DataFrame:
    """(pixel, t, prominence) of all local maxima."""
    peaks = packed.withColumn("p", local_maxima(F.col("v")))
    both = F.arrays_zip(F.col("p").alias("t"), prominences(F.col("v"), F.col("p")).alias("prominence"))
    return peaks.select(*PIXEL, F.explode(both).alias("e")).select(*PIXEL, "e.t", "e.prominence")


def level_crossing(packed: DataFrame, duration: float, share: float = 0.5) -> DataFrame:
    """When each signal first reaches a share of its range."""
    v = F.col("v")
    level = F.array_min(v) + share * span(v)
    return packed.select(*PIXEL, time_at_level(v, F.lit(0), F.size(v), level, F.size(v), duration, True).alias("time_s"))


def activation_map(packed: DataFrame, mask: DataFrame, beats: DataFrame, fps: float, duration: float) -> DataFrame:
    """(pixel, activation_ms) of active pixels: the mean over beats of when the pixel first rose halfway to its value at the beat, after
    the first pixel that did. The search begins 3 s before the beat, so it may find an earlier rise; null where no beat gives a time.
    """
    lookback = int(fps * 3.0)
    active = packed.join(mask.where("active").select(*PIXEL), PIXEL)
    # beats are one row for each recording
    each = active.join(beats, "recording_id").select(*PIXEL, "v", F.explode("beats").alias("beat")).where(F.col("beat") < F.size("v"))
    start, end, v, n = F.greatest(F.col("beat") - lookback, F.lit(0)), F.col("beat") + 1, F.col("v"), F.size("v")
    each = each.withColumn("low", F.array_min(part(v, start, end)))
    rise = F.get(v, F.col("beat")) - F.col("low")
    step = duration / F.greatest(n - 1, F.lit(1))

    def crossed(hit: Column) -> Column:
        y1, y2 = F.get(v, hit - 1), F.get(v, hit)
        share = F.when(y2 > y1, (F.col("low") + 0.5 * rise - y1) / (y2 - y1)).otherwise(0.0)
        return F.when(hit == start, time_of(start, n, duration)).otherwise((hit - 1 + share) * step)

    when = let(first_where(v, start, end, lambda x: x >= F.col("low") + 0.5 * rise), crossed)
    timed = each.withColumn("at", F.when((end - start >= 2) & (rise >= 1e-6), when))
    earliest = timed.groupBy("recording_id", "beat").agg(F.min("at").alias("earliest"))
    return timed.join(earliest, ["recording_id", "beat"]).withColumn("late", F.col("at") - F.col("earliest")).groupBy(*PIXEL).agg((F.avg("late") * 1000).alias("activation_ms"))


def synchronicity(packed: DataFrame) -> DataFrame:
    """(recording_id, sync_index): mean correlation of all pairs of signals, cut to 0..1.

    With rows z of length one about their means it is (|sum z|^2 - n) / (n (n - 1)), so no pair is formed. Flat signals correlate with nothing.
    """
    z = packed.withColumn("z", centred(F.col("v"))).where(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x) > 0.5)
    sums = z.select("recording_id", F.posexplode("z").alias("t", "x")).groupBy("recording_id", "t").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    index = sums.groupBy("recording_id").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    mean = F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    known = packed.select("recording_id").distinct()
    return known.join(index.select("recording_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("sync_index")), "recording_id", "left").na.fill(0.0, ["sync_index"])
