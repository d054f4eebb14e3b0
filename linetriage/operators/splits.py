"""Leakage-safe splits. Membership depends only on a seed and a key, never on row order or partitioning.

A share of a stratum is cut at the hash of its boundary member, found without sorting
the stratum; only fold dealing needs every rank, and it ranks groups, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linetriage.functions.columns import hash_number, hash_text
from linetriage.functions.sizing import attach, small_table
from linetriage.operators.groups import group_table
from linetriage.operators.ordering import rank_by_hash, rows_at_rank
from linetriage.session import bucket_count, cut_lineage
from linetriage.sources.sinks import scratch_folder

DEVELOPMENT, HOLDOUT = "development", "holdout"
COMPARED = 500_000  # rows of two compared manifests in one task
SIDES = {"only_in_first": 1, "only_in_second": -1}


def _below_hash_cut(df: DataFrame, scope: Sequence[str], tie: str, cut: Column, out: str) -> DataFrame:
    """Mark the first ``cut`` members of each scope in hash order (columns _hash and tie)."""
    at = rows_at_rank(df, scope, {"cut": cut}, value="_hash", ties=(tie,), descending=False)
    edge = small_table(at.select(*scope, F.col("_hash").alias("_edge"), F.col(tie).alias("_edge_tie")))
    before = (F.col("_hash") < F.col("_edge")) | ((F.col("_hash") == F.col("_edge")) & (F.col(tie) <= F.col("_edge_tie")))
    if scope:
        return df.join(edge, list(scope), "left").withColumn(out, F.coalesce(before, F.lit(False))).drop(
            "_edge", "_edge_tie"
        )
    row = edge.first()
    if row is None:
        return df.withColumn(out, F.lit(False))
    return df.withColumns({"_edge": F.lit(row["_edge"]), "_edge_tie": F.lit(row["_edge_tie"])}).withColumn(
        out, before
    ).drop("_edge", "_edge_tie")


def holdout_groups(groups: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Stratified group holdout: the first round(share * n) groups of each stratum in hash order."""
    ready = groups.withColumn("_hash", hash_number(hash_text(seed, "group_id")))
    marked = _below_hash_cut(ready, ["stratum"], "first_row", F.round(F.lit(share) * F.col("n")), "_held")
    return marked.withColumn("partition", F.when(F.col("_held"), HOLDOUT).otherwise(DEVELOPMENT)).drop("_held", "_hash")


def deal_folds(
    groups: DataFrame, k: int | str, seed: int, scope: Sequence[str] = (), out: str = "fold"
) -> DataFrame:
    """Deal the groups of each stratum to folds in hash order, each stratum starting where the last one stopped.

    ``k`` is a number or the name of a column holding the number of folds of the scope.
    """
    scope = list(scope)
    folds = F.lit(k) if isinstance(k, int) else F.col(k)
    text = hash_text(seed, *scope, "group_id")
    ranked = rank_by_hash(groups.withColumn("_text", text), [*scope, "stratum"], "_text", "first_row", "_rank")
    strata = groups.groupBy(*scope, "stratum").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*(scope or [F.lit(0)])).orderBy("stratum").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = small_table(strata.select(
        *scope, "stratum", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start")
    ))
    dealt = ranked.join(starts, [*scope, "stratum"])
    fold = F.pmod(F.col("_rank") - 1 + F.col("_start"), folds.cast("long")).cast("int")
    return dealt.withColumn(out, fold).drop("_rank", "_rank_total", "_start", "_text")


def split_manifest(
    df: DataFrame, features: Sequence[str], share: float = 0.2, k: int = 5, seed: int = 0
) -> DataFrame:
    """Partition of every row, and its validation fold when it is in development."""
    # The group table feeds several passes (boundary, ranks, join back): compute it once.
    groups = cut_lineage(group_table(df, features))
    held = holdout_groups(groups, share, seed)
    folds = deal_folds(held.where(F.col("partition") == DEVELOPMENT), k, seed)
    placed = folds.unionByName(
        held.where(F.col("partition") == HOLDOUT).withColumn("fold", F.lit(None).cast("int"))
    )
    keys = ["segment", *features]
    rows = attach(df.select("row_id", "label", *keys), placed, keys, "group_rows", sizes=groups)
    return rows.select("segment", "row_id", "label", "group_id", "partition", "fold")


def inner_folds(groups: DataFrame, outer: Sequence[int], seed: int, most: int = 3) -> DataFrame:
    """Inner folds of each outer training set: k = min(most, smallest stratum), at least 2.

    Returns one row per (outer, group) with ``inner_fold``; a stratum too small for two folds is an error.
    """
    training = groups.withColumn("outer", F.explode(F.array(*[F.lit(int(o)) for o in outer]))).where(
        F.col("outer") != F.col("fold")
    )
    sizes = training.groupBy("outer", "stratum").agg(F.count(F.lit(1)).alias("c")).groupBy("outer").agg(
        F.least(F.lit(most), F.min("c")).alias("inner_k")
    )
    checked = F.when(F.col("inner_k") >= 2, F.col("inner_k")).otherwise(
        F.raise_error(F.lit("too few groups for inner selection")).cast("long")
    )
    training = training.join(small_table(sizes.withColumn("inner_k", checked)), "outer")
    return deal_folds(training, "inner_k", seed, ["outer"], "inner_fold")


def membership_wide(inner: DataFrame, outer: Sequence[int]) -> DataFrame:
    """One column per outer fold, for export; null where the group is not in that training set."""
    return inner.groupBy("group_id").agg(*[
        F.max(F.when(F.col("outer") == o, F.col("inner_fold"))).alias(f"inner_fold_when_outer_{o}") for o in outer
    ])


def random_split(df: DataFrame, share: float, seed: int, stratify: str | None = None) -> DataFrame:
    """Row split; ceil(share * n) test rows overall or per stratum."""
    ready = df.withColumn("_hash", hash_number(hash_text(seed, "row_id")))
    scope = [stratify] if stratify else []
    return _below_hash_cut(ready, scope, "row_id", F.ceil(F.lit(share) * F.col("n")), "test").drop("_hash")


def group_split(df: DataFrame, share: float, seed: int, group: str) -> DataFrame:
    """Whole groups go to one side; ceil(share * groups) groups are test."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_hash", hash_number(hash_text(seed, group))
    )
    marked = _below_hash_cut(groups, [], group, F.ceil(F.lit(share) * F.col("n")), "test")
    return attach(df, marked.select(group, "_n", "test"), [group], "_n").drop("_n")


def time_split(df: DataFrame, share: float, time: str = "ts") -> DataFrame:
    """Rows at or after the time of row floor(n * (1 - share)) + 1 are test, so equal times stay together."""
    ready = df.withColumn("_micros", F.unix_micros(F.col(time).cast("timestamp")))
    cut = F.floor(F.col("n") * F.lit(1.0 - share)) + 1
    at = rows_at_rank(
        ready, [], {"cut": cut}, value="_micros", ties=("row_id",), descending=False
    ).first()
    first = ready.agg(F.min("_micros").alias("t")).first()["t"]
    if at is None or at["_micros"] == first:
        raise ValueError("equal times at the cut leave one side empty")
    return ready.withColumn("test", F.col("_micros") >= F.lit(at["_micros"])).drop("_micros")


def order_split(groups: DataFrame, share: float = 0.8) -> DataFrame:
    """Groups by first row id: the first floor(share * n) of each segment train."""
    at = rows_at_rank(
        groups, ["segment"], {"cut": F.floor(F.lit(share) * F.col("n"))},
        value="first_row", ties=("first_row",), descending=False,
    ).select("segment", F.col("first_row").alias("_edge"))
    return groups.join(small_table(at), "segment", "left").withColumn(
        "train", F.coalesce(F.col("first_row") <= F.col("_edge"), F.lit(False))
    ).drop("_edge")


def sample_rows(df: DataFrame, rows: int, seed: int, key: str = "row_id") -> DataFrame:
    """Fixed-seed sample of n rows, the first n in hash order: cut at the hash of the last one, so nothing is sorted."""
    ready = df.withColumn("_hash", hash_number(hash_text(seed, key)))
    size = F.least(F.lit(rows).cast("long"), F.col("n"))
    return _below_hash_cut(ready, [], key, size, "_taken").where("_taken").drop("_hash", "_taken")


def compare_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """Order-free difference of two manifests: rows only in one of them, counted as often as they occur.

    Equal rows meet in partitions of about ``COMPARED`` rows, so what a task holds does not grow with the manifests.
    """
    columns = a.columns
    folder = f"{scratch_folder(a.sparkSession)}/compared"
    a.withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1))).write.parquet(folder)
    both = a.sparkSession.read.parquet(folder)
    parts = max(bucket_count(a.sparkSession), -(-both.count() // COMPARED))
    more = both.repartition(parts, *columns).groupBy(*columns).agg(F.sum("_n").alias("_n")).agg(
        *[F.coalesce(F.sum(F.greatest(F.col("_n") * sign, F.lit(0))), F.lit(0)).alias(side) for side, sign in SIDES.items()])
    return more.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("rows")) for s in SIDES])).alias("r")).select("r.*")
