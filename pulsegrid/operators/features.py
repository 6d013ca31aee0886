"""Five features of each active pixel: variance, dominant frequency, amplitude at beats, phase, duty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.arrays import let, part
from .activity import span
from .scalar import PIXEL, mean_of

FEATURES = ["puls", "dom_freq", "mean_amp", "phase_offset", "duty"]


def mean_phase(values: np.ndarray) -> np.ndarray:
    """Mean angle of the analytic signal of each row."""
    n = values.shape[1]
    double = np.zeros(n)
    double[0] = 1
    double[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        double[n // 2] = 1
    return np.angle(np.fft.ifft(np.fft.fft(values, axis=1) * double, axis=1)).mean(1)


def spectrum(v: Column, duration: float, low: float = 0.3, high: float = 5.0) -> Column:
    """(dom_freq, phase_offset) of packed signals, by Fourier transforms of all signals of a batch that are equally long.

    ``dom_freq`` is the frequency in the band of the largest coefficient, of equals the lowest; 0 where the band is empty. The step of the time axis is
    duration / (frames - 1). Both are 0 for signals that are empty or not finite.
    """

    @arrow_udf(T.StructType([T.StructField("dom_freq", T.DoubleType()), T.StructField("phase_offset", T.DoubleType())]))
    def run(signals: pa.Array) -> pa.Array:
        values = [np.asarray(x if x is not None else [], float) for x in signals.to_numpy(zero_copy_only=False)]
        best, phase = np.zeros(len(values)), np.zeros(len(values))
        for n in {len(x) for x in values} - {0}:
            rows = np.array([i for i, x in enumerate(values) if len(x) == n and np.isfinite(x).all()], int)
            if not len(rows):
                continue
            stack = np.stack([values[i] for i in rows])
            phase[rows] = mean_phase(stack)
            hertz = np.arange(n // 2 + 1) * (n - 1) / (n * duration)
            inside = (hertz >= low) & (hertz <= high)
            if inside.any():
                power = np.round(np.abs(np.fft.rfft(stack, axis=1)[:, inside]), 9)
                best[rows] = np.where(power.max(1) > 0, hertz[inside][power.argmax(1)], 0.0)
        return pa.StructArray.from_arrays([pa.array(best), pa.array(phase)], ["dom_freq", "phase_offset"])

    return run(v)


def beat_amplitude(v: Column, beats: Column, fps: float) -> Column:
    """Mean over beats of the rise above the least value of the 1.5 s before; the range without beats."""
    back = max(int(1.5 * fps), 3)
    inside = F.filter(beats, lambda b: b < F.size(v))
    rises = F.transform(inside, lambda b: F.get(v, b) - F.array_min(part(v, F.greatest(b - back, F.lit(0)), b + 1)))
    return F.when(F.size(inside) > 0, mean_of(rises)).otherwise(span(v))


def duty(v: Column) -> Column:
    """Share of frames above the middle of the range; 0 for a flat signal."""
    return let(F.array_min(v) + 0.5 * span(v), lambda middle: F.when(span(v) > 1e-6, F.size(F.filter(v, lambda x: x > middle)) / F.size(v)).otherwise(0.0))


def features(packed: DataFrame, filtered: DataFrame, mask: DataFrame, beats: DataFrame, fps: float, duration: float) -> DataFrame:
    """(pixel, puls, dom_freq, mean_amp, phase_offset, duty) of active pixels; variance, spectrum and phase are those of ``filtered``."""
    active = mask.where("active").select(*PIXEL)
    both = packed.join(filtered.select(*PIXEL, F.col("v").alias("f")), PIXEL).join(active, PIXEL).join(beats, "recording_id")
    variance = let(mean_of(F.col("f")), lambda mean: F.aggregate("f", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("f"))
    told = both.withColumn("s", spectrum(F.col("f"), duration))
    return told.select(*PIXEL, variance.alias("puls"), "s.dom_freq", beat_amplitude(F.col("v"), F.col("beats"), fps).alias("mean_amp"), "s.phase_offset", duty(F.col("v")).alias("duty"))
