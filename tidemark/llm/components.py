"""Connected components of a graph of any size: alternating large and small stars, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours v.

    Aggregated before its shuffle, a hot u is one row a task; written, the least ones meet the pairs in a join of two plain
    shuffles, which Spark can split at a hot u.
    """
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) to (node, component): each node of an edge with the least node that it is connected to.

    After some rounds (logarithmic in the size in practice) every edge leads from a node to its component's least node.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = materialise(large, "large-star")
        linked = _least(down)
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialise(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
