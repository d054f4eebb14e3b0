"""Rank features and small rank reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from linetriage.functions.sizing import attach, small_table
from linetriage.operators.budget import boundaries, inside_at
from linetriage.operators.ordering import rank_rows, running_by_value


def average_rank(df: DataFrame, scope: Sequence[str], value: str = "score", out: str = "share_rank") -> DataFrame:
    """Average rank of ties divided by the scope's row count. The result depends on the batch it is computed in."""
    scope = list(scope)
    placed = running_by_value(df, scope, value, {"_n": F.lit(1)}, descending=False)
    ranked = placed.select(
        *scope, value, "_n", ((F.col("_n_before") + (F.col("_n") + 1) / 2.0) / F.col("_n_total")).alias(out)
    )
    return attach(df, ranked, [*scope, value], "_n").drop("_n")


def first_per_segment(df: DataFrame, rows: int, value: str = "score") -> DataFrame:
    """Best ``rows`` rows of each segment; the constant limit is applied before the shuffle."""
    order = Window.partitionBy("segment").orderBy(F.col(value).desc(), F.col("row_id"))
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= rows)


def rank_audit(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rank of each positive row in its segment, whether budgets take it, and whether it ties with the last one taken."""
    scope = [*dims, "segment"]
    narrow = df.select(*scope, "row_id", "label", "score")
    edges = boundaries(narrow, scope, [0.1, 0.2]).groupBy(*scope).agg(*[
        F.max(F.when(F.col("fraction") == f, F.col(c))).alias(f"{c}_{name}")
        for f, name in ((0.1, "10"), (0.2, "20")) for c in ("edge_score", "edge_row")
    ])
    ranked = rank_rows(narrow, scope, ties=("row_id",), out="rank_in_segment")
    positives = ranked.where(F.col("label") == 1).join(small_table(edges), scope)
    return positives.select(
        *scope, "row_id", "score", F.col("rank_in_segment").cast("long").alias("rank_in_segment"),
        inside_at("edge_score_10", None, "edge_row_10").alias("selected_top10"),
        inside_at("edge_score_20", None, "edge_row_20").alias("selected_top20"),
        (F.col("score") == F.col("edge_score_10")).alias("boundary_tie"),
    )
