"""Peaks of packed signals, each signal in one pass: runs of equal values, a stack for prominences, a heap for distances.

The columns are Arrow functions over batches of signals; times grow with a signal's length (times its logarithm for the heap). A null signal
gives null, an empty one no peaks.
"""

from __future__ import annotations

from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def maxima_of(v: np.ndarray) -> np.ndarray:
    """Indexes of local maxima in order; of a plateau its middle, rounded down. Ends of the signal don't count."""
    if len(v) < 3:
        return np.empty(0, np.int32)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))  # where runs of equal values begin
    last, run = np.append(first[1:], len(v)) - 1, v[first]
    top = np.flatnonzero((run[1:-1] > run[:-2]) & (run[1:-1] > run[2:])) + 1
    return ((first[top] + last[top]) // 2).astype(np.int32)


def prominences_of(v: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Heights of peaks above the higher of their two bases, which end at the nearest strictly higher samples."""

    def bases(values: list) -> list:
        """For each sample the least value from the nearest strictly higher one before it on, its own included."""
        out, stack = [], []  # (height, least value since the one below)
        for x in values:
            least = x
            while stack and stack[-1][0] <= x:
                low = stack.pop()[1]
                least = low if low < least else least
            out.append(least)
            stack.append((x, least))
        return out

    if not len(peaks):
        return np.empty(0)
    values = v.tolist()
    left, right = np.array(bases(values)), np.array(bases(values[::-1]))[::-1]
    return v[peaks] - np.maximum(left[peaks], right[peaks])


def apart_of(v: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """Peaks at least ``distance`` apart: from the highest down (of equals the later first), a kept one removes its neighbours."""
    at, n = peaks.tolist(), len(peaks)
    heap = list(zip((-v[peaks]).tolist(), range(0, -n, -1), strict=True))
    heapify(heap)
    gone, kept = [False] * n, []
    while heap:
        i = -heappop(heap)[1]
        if gone[i]:
            continue
        kept.append(i)
        for step in (-1, 1):
            j = i + step
            while 0 <= j < n and abs(at[j] - at[i]) < distance:
                gone[j] = True
                j += step
    return peaks[np.sort(np.array(kept, np.int64))]


def each(kind: pa.DataType, run, *columns: pa.Array) -> pa.Array:
    """``run`` of the rows of list columns as numpy arrays; a null row gives null."""
    ends = [c.offsets.to_numpy() for c in columns]
    data = [c.values.to_numpy(zero_copy_only=False) for c in columns]
    out = [None if any(not c[i].is_valid for c in columns) else run(*(d[e[i] : e[i + 1]] for d, e in zip(data, ends, strict=True))) for i in range(len(columns[0]))]
    return pa.array(out, pa.list_(kind))


@arrow_udf(T.ArrayType(T.IntegerType()))
def local_maxima(v: pa.Array) -> pa.Array:
    return each(pa.int32(), maxima_of, v)


@arrow_udf(T.ArrayType(T.DoubleType()))
def prominences(v: pa.Array, peaks: pa.Array) -> pa.Array:
    return each(pa.float64(), prominences_of, v, peaks)


def keep_apart(v: Column, peaks: Column, distance: int) -> Column:
    @arrow_udf(T.ArrayType(T.IntegerType()))
    def kept(v: pa.Array, peaks: pa.Array) -> pa.Array:
        return each(pa.int32(), lambda x, p: apart_of(x, p, distance), v, peaks)

    return kept(v, peaks)


def prominent(v: Column, peaks: Column, share: float = 0.15) -> Column:
    """(p, prominence) of the peaks whose prominence is at least ``share`` of the signal's range."""
    least = F.array_max(v) - F.array_min(v)
    both = F.arrays_zip(peaks.alias("p"), prominences(v, peaks).alias("prominence"))
    return F.filter(both, lambda e: e["prominence"] >= share * least)
