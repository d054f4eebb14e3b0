"""Exact quantiles (linear interpolation) of segments of any size, from value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from linetriage.operators.ordering import running_by_value


def long_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (row, feature): columns keys, feature, x."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features
    ])
    return df.select(*keys, F.explode(pairs).alias("_f")).select(*keys, "_f.*")


def quantiles(
    df: DataFrame, scope: Sequence[str], value: str, shares: Sequence[float], count: str | None = None
) -> DataFrame:
    """Quantiles per scope of rows, or of values with a ``count`` column. Returns scope, share, quantile."""
    scope = list(scope)
    weight = F.lit(1) if count is None else F.col(count)
    placed = running_by_value(df, scope, value, {"n": weight}, descending=False)
    spot = (F.col("n_total") - 1) * F.col("share")
    low, high = F.floor(spot), F.ceil(spot)

    def covers(position):
        return (position >= F.col("n_before")) & (position < F.col("n_before") + F.col("n"))

    spots = placed.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    hits = spots.select(
        *scope, "share", (spot - low).alias("_part"),
        F.when(covers(low), F.col(value)).alias("_low"), F.when(covers(high), F.col(value)).alias("_high"),
    ).where(F.col("_low").isNotNull() | F.col("_high").isNotNull())
    ends = hits.groupBy(*scope, "share").agg(
        F.max("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_part").alias("_part")
    )
    return ends.select(
        *scope, "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile")
    )


def training_medians(df: DataFrame, features: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """Median of each feature over the rows outside a fold, per (fold, segment).

    Each distinct value with its count, not each row, is repeated for the folds it trains.
    """
    counts = long_features(df, ["segment", "fold"], features).groupBy("segment", "fold", "feature", "x").agg(
        F.count(F.lit(1)).alias("n")
    )
    others = counts.withColumn("_to", F.explode(F.array(*[F.lit(int(k)) for k in folds]))).where(
        F.col("_to") != F.col("fold")
    )
    merged = others.groupBy("segment", F.col("_to").alias("fold"), "feature", "x").agg(F.sum("n").alias("n"))
    scope = ["fold", "segment", "feature"]
    return quantiles(merged, scope, "x", [0.5], "n").select(*scope, F.col("quantile").alias("median"))


def range_bounds(
    df: DataFrame, features: Sequence[str], low: float = 0.001, high: float = 0.999, exact: bool = True
) -> DataFrame:
    """Low and high quantile of each feature in each segment. ``exact=False`` uses the quantile sketch."""
    long = long_features(df, ["segment"], features)
    scope = ["segment", "feature"]
    if not exact:
        ends = F.percentile_approx("x", [low, high], 10_000)
        return long.groupBy(*scope).agg(ends.alias("e")).select(
            *scope, F.col("e")[0].alias("low"), F.col("e")[1].alias("high")
        )
    found = quantiles(long, scope, "x", [low, high])
    return found.groupBy(*scope).agg(
        F.max(F.when(F.col("share") == low, F.col("quantile"))).alias("low"),
        F.max(F.when(F.col("share") == high, F.col("quantile"))).alias("high"),
    )
