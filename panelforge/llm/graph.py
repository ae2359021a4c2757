"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: ``root`` is the smallest node it reaches.

    Each round costs two joins on the shrinking edge table, whatever the size of a component; rounds grow with the
    logarithm of the longest path. A hub's neighbours are joined, not collected, and minima are combined before the
    shuffle. Every round is written to the shared folder. Null ends and loops are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: every larger neighbour of a node hangs on the node's smallest neighbour.
        large = both.where("b > a").join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        step = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stored(step.distinct(), "edges")
        if _same(now, after):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        now = after
    raise RuntimeError("components did not settle")


def _same(left: DataFrame, right: DataFrame) -> bool:
    """Whether two edge tables hold the same distinct edges, by counts and sums of two hashes."""
    def digest(df):
        low = F.sum(F.xxhash64("a", "b") % (1 << 31))
        high = F.sum(F.xxhash64("b", F.lit(7), "a") % (1 << 31))
        return tuple(df.agg(F.count(F.lit(1)), low, high).first())

    return digest(left) == digest(right)
