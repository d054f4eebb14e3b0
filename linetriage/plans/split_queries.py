"""Groups, audits and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.operators import groups as g, splits
from linetriage.plans import views
from linetriage.plans.registry import query
from linetriage.session import cut_lineage

FEATURES = views.FEATURES
SEED = 42

GROUPS = views.READINGS + """, groups AS (
  SELECT segment, l_quantity, l_discount, l_tax, segment || ':' || min(row_id) AS group_id, min(row_id) AS first_row,
         count(*) AS n, sum(label)::BIGINT AS p,
         segment || ':' || CASE WHEN sum(label) > 0 THEN '1' ELSE '0' END AS stratum
  FROM readings GROUP BY segment, l_quantity, l_discount, l_tax)"""

HELD = GROUPS + """, hashed AS (
  SELECT *, CAST('0x' || substr(md5('42|' || group_id), 1, 15) AS BIGINT) AS h,
         md5('42|' || group_id) AS text FROM groups),
held AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY h, first_row)
                      <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY stratum))
                 THEN 'holdout' ELSE 'development' END AS "partition" FROM hashed)"""

FOLDED = HELD + """, starts AS (
  SELECT stratum, coalesce(sum(count(*)) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS start FROM held WHERE "partition" = 'development' GROUP BY stratum),
folded AS (
  SELECT h.*, CAST((row_number() OVER (PARTITION BY h.stratum ORDER BY text, first_row) - 1 + start) % 5 AS INTEGER) AS fold
  FROM held h JOIN starts s ON h.stratum = s.stratum WHERE "partition" = 'development')"""

ON_FEATURES = "r.segment = g.segment AND r.l_quantity = g.l_quantity AND r.l_discount = g.l_discount AND r.l_tax = g.l_tax"


@query("G1 P4", f"WITH {GROUPS} SELECT r.segment, row_id, group_id, stratum FROM readings r JOIN groups g ON {ON_FEATURES}")
def feature_groups(spark: SparkSession, sf: str) -> DataFrame:
    return g.with_groups(views.readings(spark, sf), FEATURES).select("segment", "row_id", "group_id", "stratum")


@query("A1", f"""WITH {GROUPS} SELECT sum(n)::BIGINT AS rows, sum(p)::BIGINT AS positives, count(*) AS groups,
  count(*) FILTER (p > 0 AND p < n) AS ambiguous_groups,
  coalesce(sum(p) FILTER (p > 0 AND p < n), 0)::BIGINT AS ambiguous_positive_rows,
  sum(least(p, n - p))::BIGINT AS irreducible_errors, round(sum(p)::DOUBLE / sum(n), 6) AS prevalence FROM groups""")
def dup_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = g.duplicate_audit(views.readings(spark, sf), FEATURES)
    return out.withColumn("prevalence", F.round("prevalence", 6))


@query("A1", f"""WITH {views.READINGS} SELECT 'l_quantity' AS feature, count(DISTINCT l_quantity) <= 1 AS constant FROM readings
UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) <= 1 FROM readings
UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) <= 1 FROM readings""")
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    return g.constant_features(views.readings(spark, sf), FEATURES)


@query("A2", f"""WITH {GROUPS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY row_id) AS r, count(*) OVER (PARTITION BY segment) AS n
  FROM readings),
rows_ AS (SELECT segment, count(*) AS rows, sum(label)::BIGINT AS positive_rows,
  count(*) FILTER (label = 1 AND r <= greatest(1, floor(0.2::DOUBLE * n))) AS first_fifth_positives,
  count(*) FILTER (label = 1 AND r > floor(0.8::DOUBLE * n)) AS last_fifth_positives FROM placed GROUP BY segment)
SELECT * FROM rows_ JOIN (SELECT segment, count(*) AS groups, count(*) FILTER (p > 0) AS positive_groups,
  count(*) FILTER (p > 0 AND p < n) AS ambiguous_groups FROM groups GROUP BY segment) USING (segment)""")
def segment_audit(spark: SparkSession, sf: str) -> DataFrame:
    return g.segment_audit(views.readings(spark, sf), FEATURES)


@query("A3", f"""WITH {GROUPS}, sizes AS (SELECT segment, n, count(*) AS c FROM groups GROUP BY segment, n),
hist AS (SELECT segment, string_agg(n || ':' || c, ',' ORDER BY n) AS group_size_counts FROM sizes GROUP BY segment)
SELECT segment, sum(n)::BIGINT AS rows, sum(p)::BIGINT AS positive_rows, count(*) AS groups,
  count(*) FILTER (p > 0 AND p < n) AS conflicting_groups,
  coalesce(sum(p) FILTER (p > 0 AND p < n), 0)::BIGINT AS positive_rows_in_conflicting_groups,
  any_value(group_size_counts) AS group_size_counts
FROM groups JOIN hist USING (segment) GROUP BY segment""")
def conflict_report(spark: SparkSession, sf: str) -> DataFrame:
    out = g.conflict_report(views.readings(spark, sf), FEATURES)
    text = F.transform(F.map_entries("group_size_counts"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return out.withColumn("group_size_counts", F.array_join(text, ","))


@query("A4", f"""WITH {GROUPS}, s AS (SELECT segment, sum(n)::BIGINT AS rows, sum(p)::BIGINT AS positives,
  count(*) FILTER (p > 0 AND p < n) AS conflicting_groups,
  coalesce(sum(n - p) FILTER (p > 0), 0)::BIGINT AS unavoidable_false_positives FROM groups GROUP BY segment),
t AS (SELECT *, CAST(ceil(0.1::DOUBLE * rows) AS BIGINT) AS k FROM s)
SELECT *, round(positives::DOUBLE / (positives + unavoidable_false_positives), 6) AS precision_bound_full_recall,
  round(2.0::DOUBLE * positives / (2 * positives + unavoidable_false_positives), 6) AS f1_bound_full_recall,
  round(least(positives, k)::DOUBLE / k, 6) AS precision_bound_at_k,
  round(2.0::DOUBLE * least(positives, k) / (k + positives), 6) AS f1_bound_at_k FROM t""")
def identifiability(spark: SparkSession, sf: str) -> DataFrame:
    out = g.identifiability(views.readings(spark, sf), FEATURES)
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query("W6 P14", f"""WITH {GROUPS}, m AS (SELECT count(*)::DOUBLE / sum(n) AS mean FROM groups)
SELECT r.segment, row_id, p > 0 AND p < n AS conflict, n AS group_rows, round((1.0::DOUBLE / n) / mean, 6) AS group_weight
FROM readings r JOIN groups g ON {ON_FEATURES} CROSS JOIN m""")
def group_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return g.row_attributes(views.readings(spark, sf), FEATURES).select(
        "segment", "row_id", "conflict", "group_rows", F.round("group_weight", 6).alias("group_weight")
    )


@query("G9", f"""WITH {GROUPS} SELECT segment, group_id, first_row AS row_id, n AS group_rows,
  CASE WHEN p > 0 THEN 1 ELSE 0 END AS label, l_quantity, l_discount, l_tax FROM groups""")
def event_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = g.with_groups(views.readings(spark, sf), FEATURES).drop("group_rows")
    return g.collapse_events(rows, FEATURES)


@query("U5", f"""WITH {views.READINGS} SELECT segment, label, count(*) * CASE WHEN label = 1 THEN 5 ELSE 1 END AS rows,
  count(DISTINCT row_id) AS distinct_rows FROM readings GROUP BY segment, label""")
def oversample_positives(spark: SparkSession, sf: str) -> DataFrame:
    copies = g.oversample(views.readings(spark, sf).select("segment", "row_id", "label"), 5)
    per_row = copies.groupBy("segment", "label", "row_id").agg(F.count(F.lit(1)).alias("c"))
    return per_row.groupBy("segment", "label").agg(
        F.sum("c").alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    )


@query("G2 X3", f"""WITH {HELD} SELECT group_id, stratum, "partition" FROM held""")
def holdout(spark: SparkSession, sf: str) -> DataFrame:
    table = g.group_table(views.readings(spark, sf), FEATURES)
    return splits.holdout_groups(table, 0.2, SEED).select("group_id", "stratum", "partition")


@query("G3 G10 Q11", f"""WITH {FOLDED}, placed AS (
  SELECT segment, l_quantity, l_discount, l_tax, group_id, "partition", fold FROM folded UNION ALL
  SELECT segment, l_quantity, l_discount, l_tax, group_id, "partition", NULL FROM held WHERE "partition" = 'holdout')
SELECT r.segment, row_id, label, group_id, "partition", fold FROM readings r JOIN placed g ON {ON_FEATURES}""")
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_manifest(views.readings(spark, sf), FEATURES, 0.2, 5, SEED)


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    table = g.group_table(views.readings(spark, sf), FEATURES)
    held = splits.holdout_groups(cut_lineage(table), 0.2, SEED)
    return cut_lineage(splits.deal_folds(held.where(F.col("partition") == splits.DEVELOPMENT), 5, SEED))


INNER = FOLDED + """, training AS (
  SELECT o.outer_fold, f.* FROM folded f CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS outer_fold) o WHERE o.outer_fold <> f.fold),
sizes AS (SELECT outer_fold, stratum, count(*) AS c FROM training GROUP BY ALL),
ks AS (SELECT outer_fold, {k} AS k FROM sizes GROUP BY outer_fold),
inner_starts AS (SELECT outer_fold, stratum, coalesce(sum(c) OVER (PARTITION BY outer_fold ORDER BY stratum
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sizes),
inner_ AS (SELECT t.outer_fold AS outer_fold, group_id, CAST((row_number() OVER (PARTITION BY t.outer_fold, t.stratum
    ORDER BY md5('{seed}|' || t.outer_fold || '|' || group_id), first_row) - 1 + s) % k AS INTEGER) AS inner_fold
  FROM training t JOIN ks USING (outer_fold) JOIN inner_starts i ON t.outer_fold = i.outer_fold AND t.stratum = i.stratum)"""


@query("G4", f"WITH {INNER.format(k='least(3, min(c))', seed=7)} SELECT * FROM inner_")
def inner_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return splits.inner_folds(_folded(spark, sf), range(5), 7).select(
        F.col("outer").alias("outer_fold"), "group_id", "inner_fold"
    )


@query("G5", f"""WITH {INNER.format(k='5', seed=42)} SELECT group_id, """ + ", ".join(
    f"max(CASE WHEN outer_fold = {o} THEN inner_fold END) AS inner_fold_when_outer_{o}" for o in range(5)
) + " FROM inner_ GROUP BY group_id")
def calibration_kfold(spark: SparkSession, sf: str) -> DataFrame:
    inner = splits.inner_folds(_folded(spark, sf), range(5), SEED, most=5)
    return splits.membership_wide(inner, range(5))


@query("G6", f"""WITH {views.OBS}, h AS (SELECT *, CAST('0x' || substr(md5('42|' || row_id), 1, 15) AS BIGINT) AS h FROM obs)
SELECT row_id, row_number() OVER (ORDER BY h, row_id) <= ceil(0.3::DOUBLE * count(*) OVER ()) AS random_test,
       row_number() OVER (PARTITION BY label ORDER BY h, row_id) <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY label))
       AS stratified_test FROM h""")
def random_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf).select("row_id", "label")
    first = splits.random_split(rows, 0.3, SEED).withColumnRenamed("test", "random_test")
    return splits.random_split(first, 0.3, SEED, "label").withColumnRenamed("test", "stratified_test").drop("label")


@query("G6", """WITH u AS (SELECT user_id, CAST('0x' || substr(md5('42|' || user_id), 1, 15) AS BIGINT) AS h
  FROM events GROUP BY user_id),
t AS (SELECT user_id, row_number() OVER (ORDER BY h, user_id) <= ceil(0.25::DOUBLE * count(*) OVER ()) AS test FROM u)
SELECT event_id AS row_id, user_id, test FROM events JOIN t USING (user_id)""")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf).select("row_id", "user_id")
    return splits.group_split(rows, 0.25, SEED, "user_id")


@query("G7", f"""WITH {views.TIMED}, o AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) AS r, count(*) OVER () AS n FROM timed),
cut AS (SELECT ts AS t FROM o WHERE r = floor(n * (1 - 0.2::DOUBLE)) + 1)
SELECT row_id, ts >= t AS test FROM timed CROSS JOIN cut""")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.time_split(views.timed(spark, sf), 0.2).select("row_id", "test")


@query("G8", f"""WITH {GROUPS} SELECT segment, group_id,
  row_number() OVER (PARTITION BY segment ORDER BY first_row) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY segment)) AS train
FROM groups""")
def order_split(spark: SparkSession, sf: str) -> DataFrame:
    table = g.group_table(views.readings(spark, sf), FEATURES)
    return splits.order_split(table).select("segment", "group_id", "train")


@query("G11", "SELECT event_id AS row_id, value FROM events ORDER BY md5('5|' || event_id), event_id LIMIT 500")
def fixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample_rows(views.observations(spark, sf).select("row_id", "value"), 500, 5)


@query("G10 U2", "SELECT * FROM (VALUES ('only_in_first', 0::BIGINT), ('only_in_second', 0)) v(side, rows)")
def manifest_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.readings(spark, sf)
    again = splits.split_manifest(rows.repartition(16, "l_partkey"), FEATURES, 0.2, 5, SEED)
    return splits.compare_manifests(splits.split_manifest(rows, FEATURES, 0.2, 5, SEED), again)


@query("G10 U2", f"""WITH {views.READINGS} SELECT 'only_in_first' AS side, count(*) FILTER (row_id % 50 IN (7, 11)) AS rows FROM readings
UNION ALL SELECT 'only_in_second', count(*) FILTER (row_id % 50 = 11) FROM readings""")
def manifest_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Differences found in a stored split manifest from which rows were taken and in which rows changed sides."""
    true = cut_lineage(splits.split_manifest(views.readings(spark, sf), FEATURES, 0.2, 5, SEED))
    other = F.when(F.col("partition") == splits.HOLDOUT, splits.DEVELOPMENT).otherwise(splits.HOLDOUT)
    told = true.where("row_id % 50 <> 7").withColumn(
        "partition", F.when(F.col("row_id") % 50 == 11, other).otherwise(F.col("partition")))
    return splits.compare_manifests(true, told)
