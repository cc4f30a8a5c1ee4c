"""Connected components by alternating stars, with DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

MAX_ROUNDS = 60


def _towards_least(edges: DataFrame) -> DataFrame:
    """Neighbours that are larger than a node go to its least neighbour (large star)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _chain(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them (small star); ``a`` is the larger end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a long, b long).  Returns (node, root) for every node with an edge; root is the least node.

    A star's centre is met by counts and minima before any join, and each round is written to the shared folder.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state = written(ends, "edges")
    seen = None
    for step in range(MAX_ROUNDS):
        state = written(_chain(_towards_least(state).distinct()).distinct(), f"edges-{step}")
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007), *[F.sum(F.xxhash64(c) % 1_000_000_007) for c in "ba"]).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
