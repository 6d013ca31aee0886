"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id reachable, the id itself included.

    Each round is a fixed number of equi-joins on ids and ends in a written table, so lineage stays short; the number of rounds
    grows with the logarithm of the size of a component, not of the table. Self loops and repeated edges do no harm.
    """
    now = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the id itself go to the smallest
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = materialize(small.where("u <> v"), "edges")
        # done when every id hangs on one smaller id that hangs on none
        settled = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        discard(now)
        now = after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
