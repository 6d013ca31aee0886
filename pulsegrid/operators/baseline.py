"""Slow baselines: rolling envelope, exponential decay, lines through minima; arrays of a packed signal throughout."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.peaks import each, keep_apart, local_maxima
from .scalar import PIXEL


def envelope_width(frames: int) -> int:
    return max(frames // 8, 3) // 2


def sliding_quantile(v: np.ndarray, k: int, share: float = 0.1) -> np.ndarray:
    """Quantiles of the ``k`` frames to either side of each frame, fewer at the ends: one sorted window that a value enters and one leaves at a step."""
    values, n = v.tolist(), len(v)
    window, out = sorted(values[:k]), []
    for i in range(n):
        if i + k < n:
            insort(window, values[i + k])
        if i > k:
            del window[bisect_left(window, values[i - k - 1])]
        place = (len(window) - 1) * share
        at = int(place)
        low = window[at]
        out.append(low + (window[min(at + 1, len(window) - 1)] - low) * (place - at))
    return np.array(out)


def lines_of(v: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """Lines through two minima or more, carried on at the ends."""
    t = np.arange(len(v))
    i = np.clip(np.searchsorted(minima, t, "right") - 1, 0, len(minima) - 2)
    a, b = minima[i], minima[i + 1]
    return v[a] + (v[b] - v[a]) * (t - a) / (b - a)


def rolling(v: Column, frames: int) -> Column:
    """The envelope of packed signals."""
    k = envelope_width(frames)

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def run(v: pa.Array) -> pa.Array:
        return each(pa.float64(), lambda x: sliding_quantile(x, k), v)

    return run(v)


def through_minima(v: Column, minima: Column, frames: int) -> Column:
    """Lines through the minima of packed signals, the envelope where there is one at most."""
    k = envelope_width(frames)

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def run(v: pa.Array, minima: pa.Array) -> pa.Array:
        return each(pa.float64(), lambda x, m: lines_of(x, m) if len(m) > 1 else sliding_quantile(x, k), v, minima)

    return run(v, minima)


def on_axis(signals: DataFrame) -> DataFrame:
    """(pixel, t, time_s, v): a row for each pixel with arrays in frame order."""
    rows = F.array_sort(F.collect_list(F.struct("t", "time_s", "v")))
    return signals.groupBy(*PIXEL).agg(rows.alias("rows")).select(*PIXEL, "rows.t", "rows.time_s", "rows.v")


def off_axis(packed: DataFrame, *columns: str) -> DataFrame:
    """Back to one row for each frame."""
    return packed.select(*PIXEL, F.explode(F.arrays_zip("t", "time_s", *columns)).alias("e")).select(*PIXEL, "e.t", "e.time_s", *[f"e.{c}" for c in columns])


def envelope(signals: DataFrame, frames: int) -> DataFrame:
    """Rolling tenth percentile, ``env``, over max(frames // 8, 3) // 2 frames to either side; shorter at the ends."""
    return off_axis(on_axis(signals).withColumn("env", rolling(F.col("v"), frames)), "v", "env")


def _decay(t: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """exp(-t / tau) for each of ``tau``: a row for each."""
    return np.exp(-np.clip(t[None] / np.maximum(tau, 1e-5)[:, None], 0, 700))


def fit_decays(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of a * exp(-t / tau) + c with a >= 0 for each row of ``y``: for a given tau a and c are linear, so the search is over log tau alone."""

    def solve(log_tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared error, a and c, where each row has its own tau."""
        e = _decay(t, np.exp(log_tau))
        d = e - e.mean(1, keepdims=True)
        square = (d * d).sum(1)
        a = np.where(square > 1e-12, np.maximum((d * y).sum(1) / np.where(square > 1e-12, square, 1.0), 0.0), 0.0)
        c = (y - a[:, None] * e).mean(1)
        return ((y - a[:, None] * e - c[:, None]) ** 2).sum(1), a, c

    span = max(float(t[-1] - t[0]), 1e-5)
    grid = np.log(span) + np.linspace(np.log(1e-3), np.log(1e3), 61)
    k = np.argmin([solve(np.full(len(y), g))[0] for g in grid], axis=0)
    low, high = grid[np.maximum(k - 1, 0)], grid[np.minimum(k + 1, len(grid) - 1)]
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        x1, x2 = high - golden * (high - low), low + golden * (high - low)
        left = solve(x1)[0] <= solve(x2)[0]
        low, high = np.where(left, low, x1), np.where(left, x2, high)
    middle = (low + high) / 2
    _, a, c = solve(middle)
    return a, np.exp(middle), c


def fit_decay(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(a, tau, c) of one signal."""
    a, tau, c = fit_decays(t, y[None])
    return float(a[0]), float(tau[0]), float(c[0])


def decay_baseline(envelopes: DataFrame) -> DataFrame:
    """``baseline``, ``a``, ``tau``, ``c`` of packed envelopes (env, times): the fitted decay, or the envelope where it can't be fitted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, fits = [np.asarray(e, float) for e in pdf["env"]], np.full((len(pdf), 3), np.nan)
            alike: dict[bytes, list[int]] = {}  # pixels of one time axis are fitted together
            for i, (y, times) in enumerate(zip(out, pdf["times"], strict=True)):
                if len(y) >= 3 and np.isfinite(y).all():
                    alike.setdefault(np.asarray(times, float).tobytes(), []).append(i)
            for axis, rows in alike.items():
                t = np.frombuffer(axis)
                a, tau, c = fit_decays(t, np.stack([out[i] for i in rows]))
                fits[rows] = np.stack([a, tau, c], 1)
                for i, fitted in zip(rows, a[:, None] * _decay(t, tau) + c[:, None], strict=True):
                    out[i] = fitted
            told = {k: pd.array([None if np.isnan(x) else x for x in fits[:, j]], "Float64") for j, k in enumerate(("a", "tau", "c"))}
            yield pd.DataFrame({"recording_id": pdf["recording_id"], "pixel_id": pdf["pixel_id"], "baseline": out} | told)

    return envelopes.select(*PIXEL, "env", "times").mapInPandas(run, "recording_id string, pixel_id int, baseline array<double>, a double, tau double, c double")


def exponential_baseline(signals: DataFrame, frames: int) -> DataFrame:
    """(pixel, baseline): the decay fitted to each pixel's envelope."""
    known = on_axis(signals).select(*PIXEL, rolling(F.col("v"), frames).alias("env"), F.col("time_s").alias("times"))
    return decay_baseline(known).select(*PIXEL, "baseline")


def boundary_baseline(packed: DataFrame, frames: int) -> DataFrame:
    """``packed`` with ``baseline``: lines through local minima max(5, frames // 10) apart; the envelope where there is one minimum at most."""
    negative = F.transform("v", lambda x: -x)
    known = packed.withColumn("minima_", keep_apart(negative, local_maxima(negative), max(5, frames // 10)))
    return known.withColumn("baseline", through_minima(F.col("v"), F.col("minima_"), frames)).drop("minima_")


def corrected(signals: DataFrame, frames: int, model: str) -> DataFrame:
    """``signals`` without their baseline; a pixel whose baseline isn't finite is taken above its minimum. ``model`` is "Single Exp", else lines through minima."""
    known = on_axis(signals)
    known = known.join(exponential_baseline(signals, frames), PIXEL) if model == "Single Exp" else boundary_baseline(known, frames)
    bad = F.exists("baseline", lambda b: b.isNull() | F.isnan(b))
    above = F.transform("v", lambda x: x - F.array_min("v"))
    return off_axis(known.withColumn("v", F.when(bad, above).otherwise(F.zip_with("v", "baseline", lambda x, b: x - b))), "v")
