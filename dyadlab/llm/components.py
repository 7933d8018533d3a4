"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a > b). Large: each node hands its greater neighbours to its least neighbour; small: its
    smaller neighbours and itself. Least neighbours come from a partial aggregation; no neighbour list is collected."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node"))
    joined = both.join(least, "node")
    if large:
        out = joined.filter("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.filter("other <> low").select(F.col("other").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); component is the least node reachable. Loops, repeats and
    nulls are harmless; no links, no lines. Ends when a pass changes nothing."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = cut(_star(_star(edges, True), False))
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
