"""Peaks in one pass against plain searches."""

import time

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import peaks


def plain_maxima(v):
    out, i = [], 1
    while i < len(v) - 1:
        j = i
        if v[i] > v[i - 1]:
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if j + 1 < len(v) and v[j + 1] < v[i]:
                out.append((i + j) // 2)
        i = j + 1
    return out


def plain_prominence(v, p):
    left = max([k for k in range(p) if v[k] > v[p]], default=-1) + 1
    right = min([k for k in range(p + 1, len(v)) if v[k] > v[p]], default=len(v))
    return v[p] - max(min(v[left : p + 1]), min(v[p:right]))


def plain_apart(v, at, distance):
    kept = []
    for p in sorted(at, key=lambda p: (-v[p], -p)):
        if all(abs(k - p) >= distance for k in kept):
            kept.append(p)
    return sorted(kept)


def signals(n):
    rng = np.random.default_rng(0)
    return [rng.integers(0, rng.integers(2, 20), rng.integers(0, 40)).astype(float) for _ in range(n)]


def test_against_plain_searches():
    rng = np.random.default_rng(1)
    for v in signals(1500):
        found = peaks.maxima_of(v)
        assert found.tolist() == plain_maxima(v.tolist())
        assert np.allclose(peaks.prominences_of(v, found), [plain_prominence(v.tolist(), p) for p in found])
        d = int(rng.integers(1, 9))
        assert peaks.apart_of(v, found, d).tolist() == plain_apart(v, found.tolist(), d)


def test_columns(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(signals(40))] + [(100, None), (101, [])]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(3)
    at = peaks.local_maxima(F.col("v"))
    out = df.select("i", at.alias("p"), peaks.prominences(F.col("v"), at).alias("h"), peaks.keep_apart(F.col("v"), at, 4).alias("k")).collect()
    assert len(out) == len(rows)
    for i, p, h, k in out:
        v = dict(rows)[i]
        if v is None:
            assert p is None and h is None and k is None
            continue
        assert p == plain_maxima(v) and np.allclose(h, [plain_prominence(v, x) for x in p]) and k == plain_apart(v, p, 4)


def test_long_signals_take_linear_time():
    v = np.random.default_rng(2).normal(size=400_000)
    began = time.perf_counter()
    at = peaks.maxima_of(v)
    assert len(peaks.prominences_of(v, at)) == len(at) and np.diff(peaks.apart_of(v, at, 50)).min() >= 50
    assert time.perf_counter() - began < 10
