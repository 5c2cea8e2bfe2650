"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges (a, b), a > b: hooks each node's larger (or smaller) neighbours to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    seen = both.filter("v > u") if larger else both.union(both.select("u", "u").toDF("u", "v"))
    made = seen.join(least, "u").filter("v != m")
    return made.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Each pass is two shuffles of the edges with map-side minima; edges, never
    pairs within a component, are what travels.  Passes grow with the logarithm of
    the longest path; each is checkpointed, and only a count and a checksum reach
    the driver.  Equal ends and repeated edges are ignored.
    """
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.toDF("node", "root").union(edges.select("b", "b").distinct())
        mark, edges = now, cut(_star(_star(edges, True), False))
