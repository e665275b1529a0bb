"""Connected components by alternating stars, with every round written to scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.plans.scratch import scratch_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours, or the node and its smaller."""
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = seen.join(least, "a")
    if large:
        hung = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    return hung.filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge ``a, b`` (longs); roots are the smallest nodes.

    Rounds of large and small stars take about the logarithm of the longest path. Each round
    is one written table; a hub's neighbours are aggregated, never collected.
    """
    current = edges.filter("a <> b").select("a", "b").distinct()
    before = None
    while True:
        current = scratch_table(_star(_star(current, True), False), "stars")
        mark = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).head()
        if mark == before:
            break
        before = mark
    low = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return low.unionByName(roots)
