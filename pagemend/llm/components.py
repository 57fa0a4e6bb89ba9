"""Connected components of an edge table, by alternating large and small stars.

Every step takes minima a node (combined before the shuffle) and joins them back, so a hub
with a third of all edges is only a skewed join, which adaptive execution splits. Edges
are cut to the shared folder each round; nothing is collected but whether all edges form stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads to the least node of its component: no node has two edges down, or edges both ways."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 and down > 0").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, comp): comp is the least node reachable; nodes without edges are left out."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = large.join(_least(large), "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    return now.unionByName(now.select(F.col("b").alias("a"), "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("comp"))
