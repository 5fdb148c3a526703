"""Connected components of a link table by alternating star steps.

Every step is a partial aggregate and a join of the links to each node's least neighbour.  The joins are NULL-safe, for which
Spark shuffles both sides, so adaptive execution can split a node with very many links.  No neighbour list is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.scratch import Scratch

MAX_ROUNDS = 60


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Null ends and self links are ignored.  Large-star hangs the larger neighbours of every node on its
    smallest neighbour, small-star the smaller ones and the node itself; the links become stars around the
    smallest node after O(log^2 n) rounds.  No links give an empty table.
    """
    pair = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.keep(pair.where(F.col("a") != F.col("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("low"))
        large = scratch.keep(both.where(F.col("b") > F.col("a")).join(low, F.col("a").eqNullSafe(F.col("k")))
                             .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), "low")
        small = low.select(F.col("k").alias("a"), F.col("low").alias("b")).unionByName(
            large.join(low, F.col("a").eqNullSafe(F.col("k"))).where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")))
        edges = scratch.keep(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def extended(labels: DataFrame, joins: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, component) after further links (a, b) between components; a node without links is its own component.

    Only the components that ``joins`` names go through the star steps again.
    """
    top = scratch.keep(components(joins, scratch)).select(F.col("node").alias("n"), F.col("component").alias("c"))
    moved = labels.join(top, F.col("component") == F.col("n"), "left").select("node", F.coalesce("c", "component").alias("component"))
    return moved.unionByName(top.join(labels, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("c").alias("component")))
