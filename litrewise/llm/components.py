"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.placement import settle

MOST_ROUNDS = 60


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node `a` to the smaller `b`."""
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")
    return edges.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node with the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m"))
    lowest = lowest.select("a", F.least("a", "m").alias("m"))
    return _oriented(both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours with the smallest of them."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.unionByName(lowest.select("a", F.col("m").alias("b"))))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node points to one root and no root points on."""
    many = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return many.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge in `edges` (a, b); the root is the smallest
    node of its component and has no row itself. Each round is written, so that a lost executor
    costs one round; the number of rounds grows with the logarithm of the components' size."""
    stars = settle(_oriented(edges))
    for _ in range(MOST_ROUNDS):
        if _are_stars(stars):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        stars = settle(_small_star(_large_star(stars)))
    raise RuntimeError("components did not settle")
