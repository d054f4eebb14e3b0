"""Whole-table column profile and order-free table checksum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from linetriage.functions.columns import hash_number


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, rows, nulls and distinct values of every column, over all rows.

    Exact distinct counts are a two-level aggregation of (column, value), so no task keeps a
    set of values; ``exact=False`` uses the sketch and needs no shuffle of values.
    """
    kinds = dict(df.dtypes)
    if not exact:
        aggs = [F.struct(
            F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"),
            F.approx_count_distinct(c).alias("distinct_values"),
        ).alias(c) for c in df.columns]
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(c).alias("p")) for c in df.columns
        ])
        return df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.column", "c.kind", "c.p.*")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(c).cast("string").alias("v"))
        for c in df.columns
    ])
    values = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "kind", "v").agg(
        F.count(F.lit(1)).alias("n")
    )
    return values.groupBy("column", "kind").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("v").alias("distinct_values"),
    )


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and the sum of a hash per row: equal for equal tables in any row order or partitioning."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(hash_number(F.md5(text), 12).cast("decimal(38,0)")).cast("string").alias("checksum"),
    )


def fast_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Same idea with Spark's own 64-bit hash: cheaper, but only comparable between Spark runs."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("checksum"),
    )
