"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sedge.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges`` holds (u, v) with u > v once each.

    Every node's least neighbour comes from a map-side combined minimum and is joined back, so a node
    with very many links is never gathered; the join's skewed side is split by adaptive execution.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u")
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected link table ``edges(u, v)``; component is the least node id.

    Null ends and self-links are ignored, repeated links count once, an empty table gives an empty result.
    Each round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = cut(pairs, "edges")
    seen = None
    for _ in range(max_rounds):
        now = cut(_star(_star(now, True), False), "star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
