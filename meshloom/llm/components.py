"""Connected components of an edge table: smallest labels spread over the edges and over the labels themselves."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: A node of more edges is hot; up to so many hot nodes are sent to all executors, which is checked.
HOT_EDGES, HOT_NODES = 1_000, 200_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges a, b with the m of their a in `least` (a, m, n edges; a written table). The edges of a hot node stay where they
    are and get its m from a table of the hot nodes, so no node's edges meet in one task; beyond HOT_NODES all are joined
    alike."""
    hot = least.where(F.col("n") > HOT_EDGES).select("a", "m")
    if not 0 < hot.count() <= HOT_NODES:
        return edges.join(least.select("a", "m"), "a")
    near = edges.join(F.broadcast(hot), "a")
    return near.unionByName(edges.join(F.broadcast(hot), "a", "left_anti").join(least.select("a", "m"), "a"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for every node of the edges a, b.

    Alternates the large-star and small-star steps (Kiveris and others, 2014), which keep the number of edges
    bounded and end after about a logarithm of the longest path's rounds. Every round is written to the shared
    folder; only the number of changed rows reaches the driver. It goes on until nothing changes.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    changed = pairs.limit(1).count()
    while changed:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node points to the smallest of its neighbourhood.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        large = cut(large, "edges")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = _with_least(large, low).select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small, "edges")
        changed = new.join(pairs, ["a", "b"], "left_anti").limit(1).count() + pairs.join(new, ["a", "b"], "left_anti").limit(1).count()
        release(least, large, low, pairs)
        pairs = new
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
