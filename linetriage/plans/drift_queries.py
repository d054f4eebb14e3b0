"""Drift and table comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.operators import drift
from linetriage.operators.quantiles import range_bounds
from linetriage.plans import views
from linetriage.plans.queue_queries import FEATURES, FIT_UNTIL
from linetriage.plans.registry import query

LONG_SQL = views.READINGS + ", long AS (" + " UNION ALL ".join(
    f"SELECT segment, '{f}' AS feature, {f}::DOUBLE AS x, l_shipdate < TIMESTAMP '{FIT_UNTIL}' AS fit FROM readings"
    for f in FEATURES
) + ")"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = views.readings(spark, sf)
    early = F.col("l_shipdate") < F.lit(FIT_UNTIL).cast("timestamp_ntz")
    return rows.where(early), rows.where(~early)


@query("A23", f"""WITH {LONG_SQL} SELECT segment, feature, round(quantile_cont(x, 0.001), 6) AS low,
  round(quantile_cont(x, 0.999), 6) AS high FROM long WHERE fit GROUP BY ALL""")
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    out = range_bounds(_halves(spark, sf)[0], FEATURES)
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


KS_SQL = LONG_SQL + """, c AS (SELECT segment, feature, x, count(*) FILTER (fit) AS a, count(*) FILTER (NOT fit) AS b FROM long GROUP BY ALL),
d AS (SELECT segment, feature, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap
  FROM c WINDOW w AS (PARTITION BY segment, feature ORDER BY x), p AS (PARTITION BY segment, feature)),
ks AS (SELECT segment, feature, max(gap) AS ks FROM d GROUP BY ALL)"""


@query("A24", f"""WITH {KS_SQL} SELECT segment, feature, round(ks, 6) AS ks FROM ks""")
def ks_drift(spark: SparkSession, sf: str) -> DataFrame:
    return drift.ks_distance(*_halves(spark, sf), FEATURES).withColumn("ks", F.round("ks", 6))


@query("A24 T3", f"""WITH {KS_SQL}, r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY ks DESC, feature) AS INTEGER) AS position,
    quantile_cont(ks, 0.5) OVER (PARTITION BY segment) AS m FROM ks)
SELECT segment, feature, round(ks, 6) AS ks, position, round(m, 6) AS median_ks FROM r WHERE position <= 2""")
def ks_largest(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.ks_summary(drift.ks_distance(*_halves(spark, sf), FEATURES), 2)
    return out.withColumns({c: F.round(c, 6) for c in ("ks", "median_ks")})


@query("Q5", f"""WITH {LONG_SQL}, s AS (SELECT segment, feature, avg(x) AS m, stddev_pop(x) AS s, count(DISTINCT x) > 1 AS v, count(*) AS n
  FROM long GROUP BY ALL)
SELECT segment, max(n) AS rows, round(max(abs(m)), 4) AS max_abs_mean,
  round(max(abs(s - 1)) FILTER (v), 4) AS max_abs_std_minus_one FROM s GROUP BY segment""")
def std_drift(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.standardisation_drift(views.readings(spark, sf), FEATURES)
    return out.withColumns({c: F.round(c, 4) for c in ("max_abs_mean", "max_abs_std_minus_one")})


@query("A37 J3", f"""WITH {views.OBS}, b AS (SELECT row_id, score + CASE WHEN user_id % 7 = 0 THEN 1e-3 ELSE 0 END AS score
  FROM obs WHERE value > 1)
SELECT count(*) AS keys, count(*) FILTER (b.row_id IS NULL) AS only_in_first, count(*) FILTER (a.row_id IS NULL) AS only_in_second,
  round(max(abs(a.score - b.score)), 6) AS max_abs_error FROM obs a FULL OUTER JOIN b ON a.row_id = b.row_id""")
def parity(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf)
    shift = F.when(F.col("user_id") % 7 == 0, 1e-3).otherwise(0.0)
    other = rows.where(F.col("value") > 1).withColumn("score", F.col("score") + shift)
    out = drift.parity(rows, other, ["row_id"], "score")
    return out.withColumn("max_abs_error", F.round("max_abs_error", 6))


@query("A35", f"""WITH {views.OBS}, a AS (SELECT user_id, sum(label)::BIGINT AS first FROM obs WHERE fold < 4 GROUP BY user_id),
b AS (SELECT user_id, sum(label)::BIGINT AS second FROM obs WHERE fold > 0 GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, first, second FROM a FULL OUTER JOIN b ON a.user_id = b.user_id
WHERE first IS DISTINCT FROM second""")
def run_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf)
    def run(part: DataFrame) -> DataFrame:
        return part.groupBy("user_id").agg(F.sum("label").alias("v"))

    return drift.run_difference(run(rows.where("fold < 4")), run(rows.where("fold > 0")), "user_id", "v")
