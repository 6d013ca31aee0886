"""Exact quantiles of large groups by selection: no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, by: str, value: str | Column, shares: list[float], accuracy: int = 20_000) -> DataFrame:
    """(by, n, low, high, q): how many numbers a group has, the least, the greatest, and its quantiles, linear between the two nearest ranks.

    A first pass brackets each wanted rank by a mergeable sketch of bounded size. A second one counts the values below a bracket and, by value, those
    inside, summed before they are shuffled; they are about n * 8 / ``accuracy``. The row of the wanted rank is found among these counts in order, with
    spill. Equal values are one row. A group without a number has no row; a bracket that misses its rank is an error, never another value.
    """
    v = F.col(value) if isinstance(value, str) else value
    values = df.select(by, v.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    slack = 4 / accuracy
    near = F.percentile_approx("v", [min(max(s + d, 0.0), 1.0) for s in shares for d in (-slack, slack)], accuracy)
    whole = values.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), near.alias("near"))

    def bound(i: int, end: int) -> Column:
        edge = shares[i] + (slack if end else -slack)
        return F.col("low") if edge <= 0 else F.col("high") if edge >= 1 else F.col("near")[2 * i + end]

    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    side = [F.when(F.col("v") < bound(i, 0), -1).when(F.col("v") > bound(i, 1), 1).otherwise(0) for i in range(len(shares))]
    told = [F.struct(F.lit(i).alias("i"), s.alias("side"), F.when(s == 0, F.col("v")).alias("w")) for i, s in enumerate(side)]
    each = values.join(whole, by).select(by, "n", "low", "high", "v", F.explode(F.array(*told)).alias("e"))
    counts = each.groupBy(by, "n", "low", "high", "e.i", "e.side", "e.w").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    ranked = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(by, "i").orderBy("side", "w")))
    first, last = F.col("upto") - F.col("c"), F.col("upto") - 1

    def at(i: int, rank: Column) -> Column:
        # next to a bracket the greatest value below it and the least above it are known, too
        value = F.when((rank == last) | (F.col("side") == 0) & rank.between(first, last), F.col("most")).when((F.col("side") == 1) & (rank == first), F.col("least"))
        return F.max(F.when(F.col("i") == i, value))

    picked = ranked.groupBy(by, "n", "low", "high").agg(*[at(i, f(place[i])).alias(f"{name}_{i}") for i in range(len(shares)) for name, f in (("a", F.floor), ("b", F.ceil))])
    missed = F.raise_error(F.lit("a bracket missed its rank")).cast("double")

    def between(i: int) -> Column:
        a, b = (F.coalesce(f"{name}_{i}", missed) for name in ("a", "b"))
        share = place[i] - F.floor(place[i])
        return F.when(share == 0, a).otherwise(a * (1 - share) + b * share)

    return picked.select(by, "n", "low", "high", F.array(*[between(i) for i in range(len(shares))]).alias("q"))
