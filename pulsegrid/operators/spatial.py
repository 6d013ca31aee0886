"""Stencils on the pixel grid: blur, block means, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_weights(sigma: float) -> np.ndarray:
    """A normalised kernel out to four sigma."""
    if sigma <= 0:
        return np.ones(1)
    radius = int(4 * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def blur(frames: DataFrame, sigma: float | None = None) -> DataFrame:
    """Blur each frame (recording_id, t, height, width, pixels) by a separable Gaussian, mirrored at the edges.

    Without ``sigma`` it is the raw height over 204.8.
    """

    def along(a: np.ndarray, w: np.ndarray) -> np.ndarray:
        r = len(w) // 2
        padded = np.pad(a, ((r, r), (0, 0)), "symmetric")
        return sum(w[k] * padded[k : k + len(a)] for k in range(len(w)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for height, width, pixels in zip(pdf["height"], pdf["width"], pdf["pixels"], strict=True):
                w = gaussian_weights(height / 204.8 if sigma is None else sigma)
                image = np.asarray(pixels, float).reshape(height, width)
                out.append(along(along(image, w).T, w).T.ravel())
            yield pdf.assign(pixels=out)

    return frames.select("recording_id", "t", "height", "width", "pixels").mapInPandas(run, "recording_id string, t int, height int, width int, pixels array<double>")


def block_mean(pixels: DataFrame, size: int) -> DataFrame:
    """Means of ``size`` x ``size`` blocks of (recording_id, t, y, x, v); blocks over the edge are filled up with zeros."""
    by, bx = (F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "yx")
    return pixels.groupBy("recording_id", "t", by, bx).agg((F.sum("v") / (size * size)).alias("v"))


def neighbours(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """Each pair of pixels side by side or one above the other, once: src < dst, with ``columns`` of both as a_ and b_.

    ``pixels`` has recording_id, pixel_id, y, x. Two equi-joins on coordinates, so no row meets another without cause.
    """
    left = pixels.select("recording_id", F.col("pixel_id").alias("src"), "y", "x", *[F.col(c).alias(f"a_{c}") for c in columns])
    step = F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx")))).alias("step")
    reach = left.select("*", step).withColumns({"y": F.col("y") + F.col("step.dy"), "x": F.col("x") + F.col("step.dx")}).drop("step")
    right = pixels.select("recording_id", F.col("pixel_id").alias("dst"), "y", "x", *[F.col(c).alias(f"b_{c}") for c in columns])
    return reach.join(right, ["recording_id", "y", "x"]).drop("y", "x")
