"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premiumscope.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; the component is its smallest node.

    Every step is a grouped minimum (combined before the shuffle) and an equi-join that AQE can split, so a
    node with a third of all links is no single task. Self links name a node without linking it. An empty
    table gives an empty result. Rounds go on until no edge changes.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = scratch.keep(edges.select("a").union(edges.select("b")).distinct())
    state = None
    while True:
        both = edges.filter("a <> b")
        wide = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = wide.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a node move to the smallest of its neighbourhood.
        large = wide.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.filter("a <> b").distinct())
        # Small star: a node and its neighbours below it move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        following = scratch.keep(small.filter("a <> b").distinct())
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges, large)
        edges = following
        if seen == state:
            break
        state = seen
    return nodes.join(edges, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))
