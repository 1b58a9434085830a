"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    edges: two columns of one integer type; loops and repeats are ignored, nulls dropped. Each round is one
    large and one small star, written to the shared folder; the number of rounds grows with the logarithm of
    the longest path, and it ends as soon as all edges lead to nodes without a smaller neighbour. Only one number comes to the driver.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    now = written(_small_star(now))
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        now = written(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
