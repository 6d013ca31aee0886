"""Similarity graphs of neighbouring pixels, and scores of labellings on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import centre_l2, coordinates
from .spatial import neighbours


@F.pandas_udf(T.DoubleType())
def best_lag(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """Largest sum of products of two signals shifted by up to ``most`` frames, for batches of signals of one length by Fourier transform."""
    out = np.zeros(len(a))
    lengths = a.map(len).to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if not n:
            continue
        size = 1 << int(2 * n - 1).bit_length()
        x, y = (np.fft.rfft(np.stack([np.asarray(s.iloc[i], float) for i in rows]), size) for s in (a, b))
        cross = np.fft.irfft(np.conj(x) * y, size)
        for i, row in zip(rows, cross, strict=True):
            k = int(most.iloc[i])
            out[i] = max(row[: k + 1].max(), row[size - k :].max() if k else -1.0)
    return pd.Series(out)


def correlation_graph(packed: DataFrame, width: int, share: float = 0.25) -> DataFrame:
    """(recording_id, src, dst, weight): the best correlation of neighbouring signals within a quarter of the length either way, cut to 0..1."""
    pixels = coordinates(centre_l2(packed), width)
    most = F.greatest(F.lit(1), F.floor(F.size("a_v") * share).cast("int"))
    pairs = neighbours(pixels, ["v"]).withColumn("lag", F.least(most, F.greatest(F.size("a_v") - 1, F.lit(0))))
    return pairs.select("recording_id", "src", "dst", F.greatest(F.lit(0.0), F.least(F.lit(1.0), best_lag("a_v", "b_v", "lag"))).alias("weight"))


def cosine_graph(vectors: DataFrame, width: int) -> DataFrame:
    """The same edges, weighted by the cosine of the pixels' vectors, cut to 0..1; ``vectors`` has recording_id, pixel_id, embedding."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = neighbours(coordinates(vectors, width), ["embedding"])
    cosine = dot("a_embedding", "b_embedding") / F.greatest(F.sqrt(dot("a_embedding", "a_embedding")) * F.sqrt(dot("b_embedding", "b_embedding")), F.lit(1e-12))
    return pairs.select("recording_id", "src", "dst", F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)).alias("weight"))


def cluster_score(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(recording_id, score): mean weight of edges inside a cluster; 0 without any."""
    named = lambda end: labels.select("recording_id", F.col("pixel_id").alias(end), F.col("label").alias(f"l_{end}"))
    inside = edges.join(named("src"), ["recording_id", "src"]).join(named("dst"), ["recording_id", "dst"]).where("l_src = l_dst")
    known = labels.select("recording_id").distinct()
    return known.join(inside.groupBy("recording_id").agg(F.avg("weight").alias("score")), "recording_id", "left").na.fill(0.0, ["score"])
