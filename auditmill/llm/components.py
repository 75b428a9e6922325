"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames.

Each step is two aggregations of minima (combined before the shuffle) and a join; nothing is gathered on the driver
but one count and one checksum a round. Every round's minima and edges are written to the shared folder, and those of earlier rounds go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.shared import drop, scope, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that the join reads it as it is: adaptive execution then splits the edges of a hub over several tasks
    low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
    at = both.join(low, "u")
    if large:
        out = at.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = at.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of a link; component is the smallest node that links lead to.

    Nulls and links from a node to itself are ignored; repeated links count once. Without links there are no rows."""
    spark, before = links.sparkSession, None
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            break
        before = (n, total)
        old = edges
        with scope(spark) as kept:
            edges = written(_star(_star(old, True), False), "edges")
            kept.append(edges)
        drop(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
