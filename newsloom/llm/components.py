"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one shuffle of the edges with partial aggregation; a hub's neighbours are never
gathered, only the minimum of them is. Lineage is cut with a written table at every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours; a link may come twice."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all is stars: no node is linked to two others, and none that others are linked to is linked itself."""
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("to")).union(edges.select(F.col("v").alias("x"), F.lit(None).cast("bigint").alias("to")))
    of = ends.groupBy("x").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.bool_or(F.col("to").isNull()).alias("center"))
    return not of.filter(F.col("a").isNotNull() & (F.col("center") | (F.col("a") != F.col("b")))).head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (u bigint, v bigint) edges; a component is named by its smallest node."""
    now = shared_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):  # each round brings some node nearer to the smallest of its component
        before, now = now, shared_table(_small_star(_large_star(now)), "edges")
        forget(before)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v"), F.col("v"))).distinct()
