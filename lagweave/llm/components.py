"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node on an edge; root is the least node of its component.

    A step joins each edge with the least neighbour of one end; edges are distinct before and after, least neighbours
    are combined in the tasks first, and each round is a written table. No group is collected. A round that changes
    nothing ends it, which some log2 of the nodes are enough for.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(),
        "cc-edges",
    )
    seen = summary(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stored(large, "cc-large")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = stored(small.union(down.select("hi", F.col("m").alias("lo"))).distinct(), "cc-edges")
        forget(now, large)
        now, was, seen = small, seen, summary(small)
        if seen == was:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())


def summary(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges: equal when a round has changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
