"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import join_unique, settle


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of the edges a, b (long). Edges and nodes never leave the executors; the
    rounds grow with the logarithm of the longest path. Nodes of very many edges are joined by broadcast (see join_unique), so no task gets a whole star."""
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        large = _with_least(both, F.least("a", F.min("b"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large.where("a != b"), "large")
        small = _with_least(large, F.min("b"))  # here b < a in every row
        out = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(small.select("a", "m")).distinct()
        edges = settle(out, "small")
        ends = edges.select("a", F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
        # all are stars when each node has one edge upwards, or is the top of others
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max(1 - F.col("up")).alias("top")).where("up + top > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _with_least(edges: DataFrame, least: Column) -> DataFrame:
    """The edges with the column m of the node a, an aggregate over its edges."""
    table = edges.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
    if edges.count() <= common.HOT_ROWS:  # no node can have more edges
        return edges.join(table, "a")
    return join_unique(edges, settle(table, "least"), ["a"], "n")
