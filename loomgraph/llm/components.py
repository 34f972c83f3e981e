"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.shared import settle


def _star(sides: DataFrame, keep_larger: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest node of its neighbourhood.

    The minimum is pre-aggregated before the shuffle and joined back, so a hub's neighbours stay in a join
    that adaptive execution can split; no list of neighbours is ever built.
    """
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    moved = joined.where("v > u") if keep_larger else joined
    pairs = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not keep_larger:
        pairs = pairs.unionByName(least.selectExpr("u", "m AS v"))
    return pairs.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns u, v, long); root is the smallest node reachable.

    Each round is one large-star and one small-star step over (u, v) pairs with u > v, written to the
    shared folder. It stops when a round changes nothing; long paths halve each round, so the number of rounds grows
    with the logarithm of the longest path: 60 are enough for a path of 2 ** 60 nodes, more than a table has rows. Raises if `rounds` aren't enough.
    """
    state = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(state)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = state.unionByName(state.selectExpr("v AS u", "u AS v"))
        large = _star(both, keep_larger=True)
        state = settle(_star(large, keep_larger=False), "edges")
        before, mark = mark, _mark(state)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(state: DataFrame) -> tuple:
    """Size and order-free hash of the pairs."""
    return tuple(state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
