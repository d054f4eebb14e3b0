"""Joins whose strategy depends on a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from linetriage.session import bucket_count

SMALL_ROWS = 50_000


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Fix a parameter table (cut points, budgets, weights) and mark it for broadcast.

    Reads at most limit + 1 rows. A larger table comes back unchanged and without a
    hint, so the join that uses it is an ordinary shuffle join.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; keeps the keys of the left side once."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__{k}"])
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{k}" for k in keys])


def attach(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, sizes: DataFrame | None = None
) -> DataFrame:
    """Give every row the columns of its group; ``table`` has one row per key and ``weight`` rows behind it.

    A group that alone would overfill a shuffle partition is joined by broadcast (weights
    add up to the row count, so there are at most as many such groups as partitions);
    all other groups go through a shuffle join. ``sizes`` may give a cheaper table with the
    same weights.
    """
    stats = (sizes if sizes is not None else table).agg(F.sum(weight).alias("total"), F.max(weight).alias("top")).first()
    if not stats["total"]:
        return join_same(rows, table, keys)
    parts = bucket_count(rows.sparkSession)
    share = stats["total"] / parts
    if stats["top"] <= share:
        return join_same(rows, table, keys)
    hot = F.broadcast(table.where(F.col(weight) > share))
    cold = table.where(F.col(weight) <= share)
    in_hot = join_same(rows, hot, keys)
    rest = join_same(rows, hot.select(*keys), keys, "left_anti")
    return in_hot.unionByName(join_same(rest, cold, keys))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out an input that has fewer splits than there are cores; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
