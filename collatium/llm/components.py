"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatium.llm.common import keyed_join, settle


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (a, b), a > b. Connects each node's larger (smaller) neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    joined = keyed_join(both, least, ["a"], "n", total)
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    edges: long columns a and b in either order; loops and repeats are ignored, an empty table gives an empty result.
    Each round is two grouped minima that go back to the edges by node; the centre of a large star, a hot key, is sent to
    the edges instead of the edges to it. Rounds grow with the logarithm of the longest path. A table that has not
    converged in ``rounds`` rounds raises.
    """
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark, total = new, 2 * new[0]
        now = settle(_star(settle(_star(now, True, total)), False, total))
    raise RuntimeError(f"components: no fixed point after {rounds} rounds")
