"""Connected components of a graph that no machine holds: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links but the roots themselves; root is the smallest node of the component.

    Each round ties every node to the smallest of its neighbours (first the larger neighbours, then the smaller ones), so
    the rounds grow with the logarithm of a component's length. Links and minima are written tables, so a hub's rows can be
    split between tasks by adaptive execution.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # Large star: every neighbour above the node meets the least of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: the same for the neighbours below, and the node itself.
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        step = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(step.distinct(), "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (edges, least, large, low):
            discard(old)
        edges = after
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
