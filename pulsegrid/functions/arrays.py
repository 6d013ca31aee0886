"""Columns over a packed signal: an array of doubles with one value for each frame, read by index from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it or runs over elements."""
    return F.get(F.transform(F.array(value), use), 0)


def indexes(first: Column, end: Column) -> Column:
    """The integers from ``first`` up to, without, ``end``."""
    return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))


def part(values: Column, first: Column, end: Column) -> Column:
    return F.slice(values, first + 1, F.greatest(end - first, F.lit(0)))


def first_where(values: Column, first: Column, end: Column, holds: Callable[[Column], Column]) -> Column:
    """The first index in a range whose value holds, or null."""
    return F.get(F.filter(indexes(first, end), lambda i: holds(F.get(values, i))), 0)


def last_where(values: Column, first: Column, end: Column, holds: Callable[[Column], Column]) -> Column:
    return F.array_max(F.filter(indexes(first, end), lambda i: holds(F.get(values, i))))


def argmin(values: Column, first: Column, end: Column) -> Column:
    """The first index of the least value of a range, or null for an empty range."""
    return let(part(values, first, end), lambda inside: (first + F.array_position(inside, F.array_min(inside)) - 1).cast("int"))


def time_of(index: Column, n: Column, duration: Column | float) -> Column:
    """Seconds of a frame on an axis that ends with the recording: the step is duration / (n - 1)."""
    return index * duration / F.greatest(n - 1, F.lit(1))


def time_at_level(values: Column, first: Column, end: Column, level: Column, n: Column, duration: Column | float, rising: bool) -> Column:
    """When a range first reaches ``level``, between frames by linear interpolation; null if never.

    A range that begins beyond the level gives its first time, a flat step the time of its first frame.
    """

    def crossed(hit: Column) -> Column:
        y1, y2 = F.get(values, hit - 1), F.get(values, hit)
        share = F.when(y1 == y2, F.lit(0.0)).otherwise((level - y1) / (y2 - y1))
        between = time_of(hit - 1, n, duration) + share * (time_of(hit, n, duration) - time_of(hit - 1, n, duration))
        return F.when(hit == first, time_of(hit, n, duration)).otherwise(between)

    return let(first_where(values, first, end, lambda v: v >= level if rising else v <= level), crossed)


def median(values: Column) -> Column:
    """Median of an array of numbers, or null."""
    n = F.size(values)
    return F.when(n > 0, let(F.sort_array(values), lambda ordered: (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2))


def gaps(values: Column) -> Column:
    """Differences of neighbours."""
    return F.transform(indexes(F.lit(1), F.size(values)), lambda i: F.get(values, i) - F.get(values, i - 1))
