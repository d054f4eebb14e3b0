"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linetriage.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (a long, b long); the component's smallest id names it.

    Large star: every larger neighbour of a node is tied to the smallest node it knows. Small star: the
    same for the smaller ones. Both only take minima per node, which combine before the shuffle, and
    joins whose hot side Spark can split. Each round is a stored table, so a lost executor costs one
    round at most. Loops and repeated edges are harmless; null ends are dropped; no edges give no rows.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        now = stored(
            small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select("b", F.col("m").alias("b")))
            .distinct()
        )
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
