"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the least of its neighbourhood; an edge may come out several times."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = settle(both.groupBy(F.col("high").alias("low")).agg(F.min("low").alias("m")).select("low", F.least("low", "m").alias("m")))
    return edges.join(least, "low").select("high", F.col("m").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the least of those."""
    least = settle(edges.groupBy("high").agg(F.min("low").alias("m")))
    moved = edges.join(least, "high").filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return moved.unionByName(least.select("high", F.col("m").alias("low"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one lower neighbour at most, and none of those that have one is itself a lower neighbour."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node reachable, for every node of an edge.

    Rounds go on until only stars are left, which takes about the logarithm of the longest chain, and none where the
    edges are stars already.  Each round is written to the shared folder, the grouped minima too, so that the joins may
    split a node with many edges.  Null ends and loops are ignored.
    """
    now = settle(edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())
    while not _only_stars(now):
        now = settle(_small_star(_large_star(now)))
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(now.select("low").distinct().select(F.col("low").alias("node"), F.col("low").alias("component")))
