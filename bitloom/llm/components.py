"""Connected components by alternating large-star and small-star steps, all as joins and grouped minima.

Node degrees may be large: minima are combined before each shuffle and no neighbour list is ever collected.
Every round is written to the shared folder, so the plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _pairs(frame: DataFrame, a: str, b: str) -> DataFrame:
    return (
        frame.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a and b. Result: node, component (the smallest node reachable), for linked nodes."""
    edges = cut(_pairs(links, "a", "b"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = _pairs(large, "a", "b")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut(_pairs(small, "a", "b"))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    flat = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
