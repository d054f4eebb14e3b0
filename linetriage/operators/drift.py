"""Distribution checks: two-sample KS distance, standardisation drift, table-to-table differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from linetriage.functions.columns import count_if
from linetriage.operators.ordering import running_by_value
from linetriage.operators.quantiles import long_features


def ks_distance(fit: DataFrame, live: DataFrame, features: Sequence[str]) -> DataFrame:
    """Largest gap between the two empirical distribution functions, per segment and feature."""
    both = long_features(fit, ["segment"], features).withColumn("a", F.lit(1)).unionByName(
        long_features(live, ["segment"], features).withColumn("a", F.lit(0))
    )
    sums = {"fit": F.col("a"), "live": 1 - F.col("a")}
    table = running_by_value(both, ["segment", "feature"], "x", sums, descending=False)
    f1 = F.try_divide(F.col("fit_before") + F.col("fit"), F.col("fit_total"))
    f2 = F.try_divide(F.col("live_before") + F.col("live"), F.col("live_total"))
    return table.groupBy("segment", "feature").agg(F.max(F.abs(f1 - f2)).alias("ks"))


def ks_summary(distances: DataFrame, top: int = 5) -> DataFrame:
    """Median distance and the most drifted features of each segment."""
    order = Window.partitionBy("segment").orderBy(F.col("ks").desc(), "feature")
    medians = distances.groupBy("segment").agg(F.median("ks").alias("median_ks"))
    largest = distances.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
    return largest.join(medians, "segment")


def standardisation_drift(df: DataFrame, features: Sequence[str], source: str = "segment") -> DataFrame:
    """Per source: largest |mean| and largest |population deviation - 1| over the features that vary."""
    stats = long_features(df, [source], features).groupBy(source, "feature").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), (F.min("x") < F.max("x")).alias("varies"),
        F.count(F.lit(1)).alias("n"),
    )
    return stats.groupBy(source).agg(
        F.max("n").alias("rows"), F.max(F.abs("m")).alias("max_abs_mean"),
        F.max(F.when(F.col("varies"), F.abs(F.col("s") - 1.0))).alias("max_abs_std_minus_one"),
    )


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Coverage and largest absolute difference of two tables that should agree; a null beside a value is a lost row."""
    left = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return left.join(right, list(keys), "full_outer").agg(
        F.count(F.lit(1)).alias("keys"), count_if(F.col("_in_b").isNull() | (F.col("_a").isNotNull() & F.col("_b").isNull())).alias("only_in_first"),
        count_if(F.col("_in_a").isNull() | (F.col("_b").isNotNull() & F.col("_a").isNull())).alias("only_in_second"),
        F.max(gap).alias("max_abs_error"),
    )


def run_difference(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Keys whose values differ between two runs; null equals null, and numbers may differ by a tolerance."""
    left, right = a.select(key, F.col(value).alias("first")), b.select(key, F.col(value).alias("second"))
    differs = ~F.col("first").eqNullSafe(F.col("second"))
    if tolerance is not None:
        differs = differs & F.coalesce(F.abs(F.col("first") - F.col("second")) > tolerance, F.lit(True))
    return left.join(right, key, "full_outer").where(differs)
