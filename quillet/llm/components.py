"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, if_small, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long), the component being its smallest node.

    Each step replaces a node's links by links to the smallest node in sight, found by a partial minimum, so that no
    node's neighbours are ever gathered; rounds grow with the logarithm of the longest path, and none is made for what are
    stars around their smallest node already. Loops, repeated edges, either direction and edges with a null end (they are
    left out) are fine.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stage(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        seen = both.join(if_small(least), "a")
        # all are stars once the lower end of every edge is the smallest node that either end sees
        if seen.where("m <> least(a, b)").isEmpty():
            discard(least)
            break
        large = stage(seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-star")
        lower = stage(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(if_small(lower), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).distinct()
        new = stage(small, "small-star")
        for x in (now, least, large, lower):
            discard(x)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
