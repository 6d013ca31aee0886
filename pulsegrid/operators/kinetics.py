"""Kinetics of transients: one per signal, or averaged over beats. All times are in milliseconds; a missing one is null."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.arrays import argmin, gaps, indexes, last_where, let, median, part, time_at_level, time_of
from ..functions.peaks import local_maxima, prominent
from .activity import span
from .scalar import PIXEL

KINETICS = ["bpm", "amp", "f0", "t_on_ms", "t10_on", "t50_on", "t90_on", "t_off_ms", "t10_off", "t50_off", "t90_off", "cd"]


def period(peaks: Column, n: Column) -> Column:
    """Whole frames between peaks, their median cut down; half the signal for a single peak."""
    return F.when(F.size(peaks) >= 2, F.floor(median(gaps(peaks))).cast("int")).otherwise(F.floor(n / 2).cast("int"))


def apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) * 1000


def single_transient(packed: DataFrame, duration: float) -> DataFrame:
    """Kinetics of the most prominent peak of each signal; pixels of a flat signal or without a prominent peak have no row."""
    v = F.col("v")
    found = packed.select(*PIXEL, "v", F.size(v).alias("n")).where(span(v) >= 1e-6)
    found = found.withColumns({"every": local_maxima(v), "minima": local_maxima(F.transform(v, lambda x: -x))})
    found = found.withColumn("high", prominent(v, F.col("every"))).where(F.size("high") > 0)
    best = F.array_min(F.transform("high", lambda e: F.struct((-e["prominence"]).alias("h"), e["p"].alias("p"))))["p"]
    found = found.withColumns({"peak": best, "peaks": F.transform("high", lambda e: e["p"])}).drop("every", "high")
    peak, n = F.col("peak"), F.col("n")
    low = F.array_min(part(v, F.lit(0), peak + 1))
    rough = low + 0.05 * (F.get(v, peak) - low)
    start = F.coalesce(F.array_max(F.filter("minima", lambda m: m < peak)), last_where(v, F.lit(0), peak, lambda x: x <= rough), F.lit(0))
    search = F.least(n, peak + F.floor(period(F.col("peaks"), n) * 1.5).cast("int"))
    found = found.withColumns({"start": start, "search": search})
    start, search = F.col("start"), F.col("search")
    found = found.withColumns({"base": F.get(v, start), "amp": F.get(v, peak) - F.get(v, start), "end": F.coalesce(F.get(F.filter("minima", lambda m: (m > peak) & (m < search)), 0), search)})
    level = lambda share: F.col("base") + share * F.col("amp")
    rise = {f"r{k}": time_at_level(v, start, peak + 1, level(k / 100), n, duration, True) for k in (10, 50, 90)}
    fall = {f"d{k}": time_at_level(v, peak, search, level(k / 100), n, duration, False) for k in (2, 10, 50, 90)}
    found = found.withColumns(rise).withColumns(fall)
    at = lambda i: time_of(i, n, duration)
    whole = apart(F.col("d10"), F.col("r10"))
    return found.select(
        *PIXEL,
        (F.size("peaks") / duration * 60).alias("bpm"), "amp", F.col("base").alias("f0"), ((at(peak) - at(start)) * 1000).alias("t_on_ms"),
        *[apart(F.col(f"r{k}"), at(start)).alias(f"t{k}_on") for k in (10, 50, 90)],
        F.coalesce(apart(F.col("d2"), at(peak)), F.when(F.col("end") < n, apart(at(F.col("end")), at(peak)))).alias("t_off_ms"),
        apart(F.col("d90"), at(peak)).alias("t10_off"), apart(F.col("d50"), at(peak)).alias("t50_off"), apart(F.col("d10"), at(peak)).alias("t90_off"),
        F.coalesce(whole, apart(F.col("d50"), F.col("r50")) * 1.6).alias("cd"), (whole.isNull() & F.col("d50").isNotNull() & F.col("r50").isNotNull()).alias("cd_estimated"),
    )


def tau_of(times: list, shares: list) -> float | None:
    """Milliseconds of the decay of ``shares`` at ``times`` in seconds, or null; see ``decay_tau``.

    One pass from the first point on, a product and its sum rounded once, as a database's regr_slope goes: where a line hardly falls, the
    last digits of its slope are the time constant's first.
    """
    n, mt, my, both, spread = 0, 0.0, 0.0, 0.0, 0.0
    for t, share in zip(times, shares, strict=True):
        n, y, dt, before = n + 1, math.log(share), t - mt, mt
        mt += dt / n
        my += (y - my) / n
        both = math.fma(dt, y - my, both)
        spread += (t - mt) * (t - before)
    if n < 4 or not spread:
        return None
    slope = (both / n) / (spread / n)
    return -1000 / slope if slope < 0 else None


@arrow_udf(T.DoubleType())
def fitted_tau(times: pa.Array, shares: pa.Array) -> pa.Array:
    return pa.array([None if t is None else tau_of(t, s) for t, s in zip(times.to_pylist(), shares.to_pylist(), strict=True)], pa.float64())


def decay_tau(v: Column, first: Column, end: Column, base: Column, amp: Column, n: Column, duration: Column | float) -> Column:
    """Milliseconds of an exponential decay: -1 over the slope of log(y) over time, y the share of the amplitude left, between 5 and 95 %.

    Null for under 5 frames, under 4 of them in between, a tiny amplitude, or a slope that doesn't fall.
    """
    share = lambda i: (F.get(v, i) - base) / amp
    until = F.when((end - first >= 5) & (amp >= 1e-9), end).otherwise(first)
    kept = F.filter(indexes(first, until), lambda i: (share(i) > 0.05) & (share(i) < 0.95))
    return fitted_tau(F.transform(kept, lambda i: time_of(i, n, duration)), F.transform(kept, share))


def taus(packed: DataFrame, duration: float) -> DataFrame:
    """(pixel, tau_ms) of the decay from each signal's highest frame (the first of equals) to its end."""
    v, n = F.col("v"), F.size("v")
    known = packed.withColumns({"peak": (F.array_position(v, F.array_max(v)) - 1).cast("int"), "base": F.array_min(v), "amp": span(v)})
    return known.select(*PIXEL, decay_tau(v, F.col("peak"), n, F.col("base"), F.col("amp"), n, duration).alias("tau_ms"))


def beat_averaged(packed: DataFrame, beats: DataFrame, duration: float) -> DataFrame:
    """Kinetics averaged over the recording's beats; those of the single transient where there is no beat, or none that counts.

    ``beats`` has a row (recording_id, beats) for each recording. ``cd_estimated`` is null for averages.
    """
    v = F.col("v")
    signal = packed.join(beats, "recording_id", "left").select(*PIXEL, "v", F.size(v).alias("n"), F.coalesce("beats", F.array().cast("array<int>")).alias("beats"))
    n, every = F.col("n"), F.col("beats")
    signal = signal.where(span(v) >= 1e-6).withColumns({"period": period(every, n), "range": span(v), "count": F.size(every)})
    each = signal.select("*", F.explode("beats").alias("peak")).where(F.col("peak") < n)
    peak = F.col("peak")
    back = F.greatest(F.lit(0), peak - F.greatest(F.floor(F.col("period") / 2).cast("int"), F.lit(3)))
    each = each.where(back < peak).withColumn("start", argmin(v, back, peak))
    start = F.col("start")
    each = each.withColumns({"base": F.get(v, start), "amp": F.get(v, peak) - F.get(v, start)}).where(F.col("amp") >= F.col("range") * 0.05)
    stop = F.least(n, peak + F.floor(F.col("period") * 1.5).cast("int"))
    following = F.get(F.filter(every, lambda b: b > peak), 0)
    until = F.least(following, stop)
    each = each.withColumn("end", F.when(following.isNotNull() & (until - peak > 1), F.least(stop, argmin(v, peak, until) + 1)).otherwise(stop))
    end, base, amp = F.col("end"), F.col("base"), F.col("amp")
    each = each.withColumn("tau", decay_tau(v, peak, end, base, amp, n, duration))
    rise = {f"r{k}": time_at_level(v, start, peak + 1, base + k / 100 * amp, n, duration, True) for k in (10, 50, 90)}
    fall = {f"d{k}": time_at_level(v, peak, end, base + k / 100 * amp, n, duration, False) for k in (5, 10, 50, 90)}
    each = each.withColumns(rise).withColumns(fall)
    at = lambda i: time_of(i, n, duration)
    told = each.select(
        *PIXEL, "count", "amp", F.col("base").alias("f0"), ((at(peak) - at(start)) * 1000).alias("t_on_ms"),
        *[apart(F.col(f"r{k}"), at(start)).alias(f"t{k}_on") for k in (10, 50, 90)],
        F.coalesce(F.col("tau") * math.log(20), apart(F.col("d5"), at(peak))).alias("t_off_ms"), apart(F.col("d90"), at(peak)).alias("t10_off"), apart(F.col("d50"), at(peak)).alias("t50_off"),
        F.coalesce(F.col("tau") * math.log(10), apart(F.col("d10"), at(peak))).alias("t90_off"),
    )
    means = [k for k in KINETICS if k not in ("bpm", "cd")]
    averaged = told.groupBy(*PIXEL).agg((F.max("count") / duration * 60).alias("bpm"), *[F.avg(k).alias(k) for k in means])
    averaged = averaged.withColumn("cd", F.col("t_on_ms") + F.col("t_off_ms") - F.col("t10_on")).withColumn("cd_estimated", F.lit(None).cast("boolean"))
    others = packed.join(averaged.select(*PIXEL), PIXEL, "left_anti")
    return averaged.select(*PIXEL, *KINETICS, "cd_estimated").unionByName(single_transient(others, duration).select(*PIXEL, *KINETICS, "cd_estimated"))
