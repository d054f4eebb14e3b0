"""Joins with the checks a plain Spark join does not make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import count_if
from linetriage.functions.sizing import small_table


def _unique(df: DataFrame, keys: Sequence[str], side: str) -> None:
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).collect()
    if bad:
        raise ValueError(f"{side} side has a repeated key: {bad[0].asDict()}")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails when a key repeats on either side."""
    _unique(left, keys, "left")
    _unique(right, keys, "right")
    return left.join(right, list(keys), how)


def left_complete(left: DataFrame, right: DataFrame, keys: Sequence[str], probe: str) -> DataFrame:
    """Left one-to-one join; a left row without a partner is an error raised by the row itself."""
    joined = one_to_one(left, right.withColumn("_hit", F.lit(True)), keys, "left")
    fault = F.raise_error(F.concat_ws(":", F.lit("no partner for"), *[F.col(k).cast("string") for k in keys]))
    kind = dict(right.dtypes)[probe]
    return joined.withColumn(probe, F.when(F.col("_hit"), F.col(probe)).otherwise(fault.cast(kind))).drop("_hit")


def left_report(
    left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, tolerance: float = 0.0
) -> DataFrame:
    """Unmatched rows and value differences of a left join, as one row of counts; a null beside a value differs."""
    joined = left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left")
    gap = F.abs(F.col(a) - F.col(b))
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.col("_hit").isNull()).alias("unmatched"),
        count_if((gap > tolerance) | (F.col("_hit") & (F.col(a).isNull() != F.col(b).isNull()))).alias("differing"),
    )


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with ``side`` = both, left_only or right_only."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full_outer")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return joined.withColumn("side", side).drop("_l", "_r")


def candidate_pairs(
    df: DataFrame, keys: Sequence[str], candidates: Sequence[str], column: str = "candidate"
) -> DataFrame:
    """Scores of the named candidates side by side, one row per key; an incomplete or repeated pair is an error."""
    chosen = df.where(F.col(column).isin(list(candidates)))
    wide = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col(column) == c, F.col("score"))).alias(f"score_{c}") for c in candidates],
    )
    whole = F.col("_n") == len(candidates)
    for c in candidates:
        whole = whole & F.col(f"score_{c}").isNotNull()
    first = f"score_{candidates[0]}"
    fault = F.raise_error(F.concat_ws(":", F.lit("incomplete scores for"), *[F.col(k).cast("string") for k in keys]))
    return wide.withColumn(first, F.when(whole, F.col(first)).otherwise(fault.cast("double"))).drop("_n")


def against_baseline(
    table: DataFrame, baseline: str, keys: Sequence[str], metrics: Sequence[str], column: str = "model"
) -> DataFrame:
    """Each model beside the baseline of the same keys, with differences."""
    base = small_table(table.where(F.col(column) == baseline).select(
        *keys, *[F.col(m).alias(f"baseline_{m}") for m in metrics]
    ))
    return table.where(F.col(column) != baseline).join(base, list(keys)).withColumns({
        f"delta_{m}": F.col(m) - F.col(f"baseline_{m}") for m in metrics
    })


def group_bijection(a: DataFrame, b: DataFrame, keys: Sequence[str], group: str = "group_id") -> DataFrame:
    """Faults of renaming groups of ``a`` to those of ``b``: rows without partner, changed labels, split or merged groups.

    A null beside a label is a changed label, a null beside a group a split or merged one.
    """
    left = a.select(*keys, F.col(group).alias("_ga"), F.col("label").alias("_ya"), F.lit(True).alias("_l"))
    right = b.select(*keys, F.col(group).alias("_gb"), F.col("label").alias("_yb"), F.lit(True).alias("_r"))
    paired = left.join(right, list(keys), "full_outer")
    rows = paired.agg(
        count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched_rows"),
        count_if(F.col("_l") & F.col("_r") & ~F.col("_ya").eqNullSafe(F.col("_yb"))).alias("changed_labels"),
    )
    def several(own: str, other: str, name: str) -> DataFrame:
        per = paired.where(F.col("_l") & F.col("_r") & F.col(own).isNotNull()).groupBy(own).agg(
            ((F.min(other) < F.max(other)) | (F.count(other) < F.count(F.lit(1)))).alias("m"))
        return per.agg(count_if(F.col("m")).alias(name))

    out = None
    for part in (rows, several("_ga", "_gb", "split_groups"), several("_gb", "_ga", "merged_groups")):
        cells = F.array(*[
            F.struct(F.lit(c).alias("rule"), F.col(c).alias("failed_rows")) for c in part.columns
        ])
        long = part.select(F.explode(cells).alias("_r")).select("_r.*")
        out = long if out is None else out.unionByName(long)
    return out


def rename_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], group: str = "group_id") -> DataFrame:
    """Take the group names of ``b`` after proving that the groups are the same."""
    faults = group_bijection(a, b, keys, group).where(F.col("failed_rows") > 0).collect()
    if faults:
        raise ValueError("; ".join(f"{r['rule']}: {r['failed_rows']}" for r in faults))
    return a.drop(group).join(b.select(*keys, group), list(keys))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str | Column]) -> DataFrame:
    """Small-side lookup: broadcast when the table is small, shuffle join otherwise."""
    return df.join(small_table(table.select(*keys, *columns)), list(keys), "left")
