"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

A large step links every larger neighbour of a node to the node's least neighbour; a small step does so for the smaller
neighbours and the node itself. Components become stars around their least node in about log^2 of their longest path.
Each step is one aggregate and one join on narrow rows, written to the shared folder; nothing is gathered."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinaria.sources.scratch import cut, free


def _stars(edges: DataFrame) -> bool:
    """True if every node has edges on one side only, and one edge if it is the larger end."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order, repeats and loops allowed -> (id, component): each node that has an edge to another and
    the least node of its component."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    while not _stars(edges):
        old = edges
        both = edges.union(edges.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "cc-large")
        free(least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        joined = large.join(least, "a")
        edges = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(joined.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        free(old, large, least)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
