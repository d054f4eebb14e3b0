"""Queue, budget and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.functions.sizing import small_table
from linetriage.operators import budget, derive, queue as q
from linetriage.operators.ordering import rank_rows
from linetriage.operators.quantiles import range_bounds
from linetriage.operators.windows import average_rank, first_per_segment, rank_audit
from linetriage.plans import views
from linetriage.plans.registry import query
from linetriage.sources.sinks import save, scratch_folder

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FIT_UNTIL = "1998-07-01"
UNVALIDATED = ("O",)
SOURCE_HASH = "lineitem"
QUEUE_HASH = "queue-1"


def fit_bounds(spark: SparkSession, sf: str) -> DataFrame:
    fit = views.readings(spark, sf).where(F.col("l_shipdate") < F.lit(FIT_UNTIL).cast("timestamp_ntz"))
    return range_bounds(fit, FEATURES, 0.1, 0.9)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    rows = views.readings(spark, sf).withColumn("score", price / (price + 50000.0))
    return derive.out_of_range(rows, fit_bounds(spark, sf), FEATURES)


BOUNDS_SQL = views.READINGS + ", bounds AS (SELECT segment, " + ", ".join(
    f"quantile_cont({f}, {s}) AS {side}_{f}"
    for f in FEATURES for s, side in ((0.1, "low"), (0.9, "high"))
) + f" FROM readings WHERE l_shipdate < TIMESTAMP '{FIT_UNTIL}' GROUP BY segment)"

SCORED_SQL = BOUNDS_SQL + ", scored AS (SELECT r.*, l_extendedprice / (l_extendedprice + 50000.0) AS score, " + " + ".join(
    f"(CASE WHEN {f} < low_{f} OR {f} > high_{f} THEN 1 ELSE 0 END)" for f in FEATURES
) + " AS ood_feature_count FROM readings r JOIN bounds b ON r.segment = b.segment)"

QUEUE_SQL = SCORED_SQL + """, ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, segment, row_id) AS global_rank,
         row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS segment_rank,
         count(*) OVER (PARTITION BY segment) AS n FROM scored),
queue AS (
  SELECT segment, row_id, score AS risk_score, ood_feature_count, global_rank, segment_rank,
         CASE WHEN segment_rank <= ceil(0.1::DOUBLE * n) THEN 'HIGH'
              WHEN segment_rank <= ceil(0.2::DOUBLE * n) THEN 'REVIEW' ELSE 'STANDARD' END AS priority,
         ood_feature_count >= 3 AS ood_flag,
         CASE WHEN segment IN ('O') THEN 'usual_inspection_unvalidated_machine'
              WHEN ood_feature_count >= 3 THEN 'usual_inspection_ood'
              ELSE 'usual_inspection_label_unconfirmed' END AS action
  FROM ranked)"""


@query("M14 W1 P6 P7 P8 A23 J9", f"WITH {QUEUE_SQL} SELECT * FROM queue")
def queue(spark: SparkSession, sf: str) -> DataFrame:
    return q.build_queue(scored(spark, sf), UNVALIDATED)


@query("P6", f"WITH {SCORED_SQL} SELECT segment, row_id, ood_feature_count, ood_feature_count >= 3 AS ood_flag FROM scored")
def ood_count(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("segment", "row_id", "ood_feature_count", "ood_flag")


# Faults put into a stored queue, as SQL expressions that both engines read: column, new value.
TAMPER = {
    "risk_score": "CASE WHEN row_id % 101 = 4 THEN NULL WHEN row_id % 103 = 5 THEN 1.5 ELSE risk_score END",
    "ood_feature_count": "CASE WHEN row_id % 83 = 2 THEN NULL ELSE ood_feature_count END",
    "segment_rank": "CASE WHEN row_id % 97 = 0 THEN NULL WHEN row_id % 107 = 6 THEN 1 ELSE segment_rank END",
    "priority": "CASE WHEN row_id % 79 = 3 THEN 'HIGH' ELSE priority END",
    "ood_flag": "CASE WHEN row_id % 89 = 1 THEN NOT ood_flag WHEN row_id % 109 = 7 THEN NULL ELSE ood_flag END",
}
TAMPERED_SQL = QUEUE_SQL + ", bad AS (SELECT q.* REPLACE (" + ", ".join(
    f"{v} AS {c}" for c, v in TAMPER.items()
) + """) FROM queue q WHERE row_id % 113 <> 8), sized AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY segment) AS n FROM bad),
neighbours AS (SELECT risk_score, lag(risk_score) OVER (ORDER BY global_rank) AS above FROM bad WHERE risk_score IS NOT NULL AND global_rank IS NOT NULL)"""


@query("Q8 W9 U2", f"""WITH {TAMPERED_SQL}
SELECT 'null_value' AS rule, count(*) FILTER (risk_score IS NULL OR ood_feature_count IS NULL OR segment_rank IS NULL OR ood_flag IS NULL) AS failed_rows FROM sized
UNION ALL SELECT 'score', count(*) FILTER (risk_score IS NULL OR risk_score > 1) FROM sized
UNION ALL SELECT 'global_rank_range', count(*) FILTER (global_rank > total) FROM sized
UNION ALL SELECT 'segment_rank_range', count(*) FILTER (segment_rank IS NULL OR segment_rank > n) FROM sized
UNION ALL SELECT 'tier', count(*) FILTER (priority <> CASE WHEN segment_rank <= ceil(0.1::DOUBLE * n) THEN 'HIGH'
  WHEN segment_rank <= ceil(0.2::DOUBLE * n) THEN 'REVIEW' ELSE 'STANDARD' END) FROM sized
UNION ALL SELECT 'ood_flag', count(*) FILTER (ood_flag IS NULL OR ood_feature_count IS NULL OR ood_flag <> (ood_feature_count >= 3)) FROM sized
UNION ALL SELECT 'action', count(*) FILTER (action <> CASE WHEN segment IN ('O') THEN 'usual_inspection_unvalidated_machine'
  WHEN ood_flag THEN 'usual_inspection_ood' ELSE 'usual_inspection_label_unconfirmed' END) FROM sized
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM bad GROUP BY segment, row_id HAVING count(*) > 1)
UNION ALL SELECT 'global_rank_repeated', count(*) FROM (SELECT 1 FROM bad GROUP BY global_rank HAVING count(*) > 1)
UNION ALL SELECT 'segment_rank_repeated', count(*) FROM (SELECT 1 FROM bad GROUP BY segment, segment_rank HAVING count(*) > 1)
UNION ALL SELECT 'score_order', count(*) FILTER (above < risk_score) FROM neighbours
UNION ALL SELECT 'not_in_source', 0
UNION ALL SELECT 'not_in_queue', count(*) FROM readings WHERE row_id % 113 = 8""")
def queue_check(spark: SparkSession, sf: str) -> DataFrame:
    """A stored queue with faults of every kind in it, nulls included, is what gets checked."""
    folder = scratch_folder(spark) + "/queue"
    bad = queue(spark, sf).where("row_id % 113 <> 8").selectExpr(*[
        f"{TAMPER[c]} AS {c}" if c in TAMPER else c for c in q.QUEUE_COLUMNS
    ])
    save(bad, folder)
    return q.queue_faults(spark.read.parquet(folder), views.readings(spark, sf), UNVALIDATED)


@query("S12 P9 P10", f"""WITH {QUEUE_SQL}, paged AS (
  SELECT * FROM queue WHERE segment = 'F' AND segment_rank BETWEEN 31 AND 60)
SELECT segment, row_id, risk_score, segment_rank, priority,
       risk_score AS research_score, 'available' AS prediction_status,
       CASE WHEN segment <> 'F' THEN 'usual_inspection_unvalidated_machine'
            WHEN ood_flag THEN 'usual_inspection_ood' ELSE 'usual_inspection_label_unconfirmed' END AS action,
       array_to_string(list_sort(['research_only', 'field_approval_unavailable', 'label_semantics_unconfirmed',
         'target_unit_unconfirmed', 'product_shot_cavity_mapping_unconfirmed', 'feature_availability_unconfirmed',
         'inspection_timing_unconfirmed', 'raw_units_unconfirmed', 'supplier_transform_unconfirmed',
         'future_validation_data_unconfirmed'] || CASE WHEN ood_flag THEN ['out_of_training_range'] ELSE [] END), ',')
         AS reasons,
       sha256('lineitem:' || segment || ':' || row_id) AS observation_uid,
       sha256(sha256('lineitem:' || segment || ':' || row_id) || 'queue-1') AS prediction_id
FROM paged""")
def queue_page(spark: SparkSession, sf: str) -> DataFrame:
    paged = q.page(queue(spark, sf), offset=30, limit=30, segment="F")
    out = q.with_identifiers(q.decide(paged, ["F"], ["F", "O"]), SOURCE_HASH, QUEUE_HASH)
    return out.select(
        "segment", "row_id", "risk_score", "segment_rank", "priority", "research_score", "prediction_status",
        "action", F.array_join("fallback_reasons", ",").alias("reasons"), "observation_uid", "prediction_id",
    )


@query("P9 P8 A33", f"""WITH {SCORED_SQL}, w AS (
  SELECT CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 13 = 0 THEN score + 1 ELSE score END AS s,
         segment, ood_feature_count >= 3 AS ood_flag FROM scored),
d AS (SELECT *, s IS NOT NULL AND s BETWEEN 0 AND 1 AS ok FROM w)
SELECT CASE WHEN NOT ok THEN 'usual_inspection_input_error'
            WHEN segment <> 'F' THEN 'usual_inspection_unvalidated_machine'
            WHEN ood_flag THEN 'usual_inspection_ood'
            ELSE 'usual_inspection_contract_or_approval_unconfirmed' END AS action,
       array_to_string(list_sort(['research_only', 'field_approval_unavailable', 'target_unit_mismatch',
         'product_shot_cavity_mapping_unconfirmed', 'feature_availability_unconfirmed',
         'inspection_timing_unconfirmed', 'raw_units_unconfirmed', 'supplier_transform_unconfirmed',
         'future_validation_data_unconfirmed']
         || CASE WHEN segment <> 'F' THEN ['unvalidated_machine'] ELSE [] END
         || CASE WHEN ood_flag THEN ['out_of_training_range'] ELSE [] END
         || CASE WHEN NOT ok THEN ['invalid_or_missing_prediction'] ELSE [] END), ',') AS reasons,
       count(*) AS rows
FROM d GROUP BY 1, 2""")
def action_reasons(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("l_suppkey") % 11 == 0, None).when(F.col("l_suppkey") % 13 == 0, F.col("score") + 1)
    rows = scored(spark, sf).withColumn("risk_score", score.otherwise(F.col("score")))
    decided = q.decide(rows, ["F"], ["F", "O"], {"label_semantics": "confirmed", "target_unit": "mismatch"})
    return decided.groupBy("action", F.array_join("fallback_reasons", ",").alias("reasons")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("A33", f"WITH {QUEUE_SQL} SELECT segment, action, priority, count(*) AS rows FROM queue GROUP BY ALL")
def action_counts(spark: SparkSession, sf: str) -> DataFrame:
    # Counts need no order: the boundary row of each tier decides the tier of a row.
    rows = scored(spark, sf).withColumn("action", q.route_action(UNVALIDATED))
    edges = budget.boundaries(rows, ["segment"], list(q.TIER_SHARES))
    high, review = (
        edges.where(F.col("fraction") == s).select("segment", *[
            F.col(c).alias(f"{p}{c}") for c in ("edge_score", "edge_segment", "edge_row")
        ]) for s, p in zip(q.TIER_SHARES, ("h_", "r_"))
    )
    edge = high.join(review, "segment")
    test = {p: budget.inside_at(f"{p}edge_score", f"{p}edge_segment", f"{p}edge_row") for p in ("h_", "r_")}
    tiered = rows.join(small_table(edge), "segment").withColumn(
        "priority", F.when(test["h_"], q.TIERS[0]).when(test["r_"], q.TIERS[1]).otherwise(q.TIERS[2])
    )
    return tiered.groupBy("segment", "action", "priority").agg(F.count(F.lit(1)).alias("rows"))


SELECTED_SQL = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, segment, row_id) AS r,
         count(*) OVER (PARTITION BY {keys}) AS n FROM oof)"""


@query("W2 T1", f"""WITH {views.OBS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS r,
         count(*) OVER (PARTITION BY segment) AS n FROM obs)
SELECT segment, row_id, r <= ceil(0.1::DOUBLE * n) AS selected FROM ranked""")
def budget_segment(spark: SparkSession, sf: str) -> DataFrame:
    return budget.select(views.observations(spark, sf), 0.1).select("segment", "row_id", "selected")


@query("W2 T1", f"""WITH {views.OBS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, segment, row_id) AS r, count(*) OVER () AS n FROM obs)
SELECT segment, row_id, r <= ceil(0.075::DOUBLE * n) AS selected FROM ranked""")
def budget_global(spark: SparkSession, sf: str) -> DataFrame:
    return budget.select(views.observations(spark, sf), 0.075, budget.GLOBAL).select("segment", "row_id", "selected")


@query("W4", f"""WITH {views.OBS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS r,
         count(*) OVER (PARTITION BY segment) AS n FROM obs)
SELECT segment, row_id, r AS candidate_rank, r <= ceil(0.075::DOUBLE * n) AS in_budget FROM ranked""")
def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf).select("segment", "row_id", "score")
    sizes = small_table(rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
    ranked = rank_rows(rows, ["segment"], ties=("row_id",), out="candidate_rank").join(sizes, "segment")
    return ranked.select(
        "segment", "row_id", F.col("candidate_rank").cast("long"),
        (F.col("candidate_rank") <= F.ceil(F.lit(0.075) * F.col("n"))).alias("in_budget"),
    )


@query("W3", f"""WITH {views.OBS}
SELECT segment, row_id, fold, round((rank() OVER (PARTITION BY segment, fold ORDER BY score)
       + (count(*) OVER (PARTITION BY segment, fold, score) - 1) / 2.0)
       / count(*) OVER (PARTITION BY segment, fold)::DOUBLE, 9) AS share_rank FROM obs""")
def frac_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf)
    return average_rank(rows, ["segment", "fold"]).select(
        "segment", "row_id", "fold", F.round("share_rank", 9).alias("share_rank")
    )


@query("W5", f"""WITH {views.OOF}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, seed, segment ORDER BY score DESC, row_id) AS r,
         count(*) OVER (PARTITION BY model, seed, segment) AS n FROM oof),
edge AS (SELECT model, seed, segment, score AS e FROM ranked WHERE r = ceil(0.1::DOUBLE * n))
SELECT model, seed, segment, row_id, round(score, 9) AS score, r AS rank_in_segment,
       r <= ceil(0.1::DOUBLE * n) AS selected_top10, r <= ceil(0.2::DOUBLE * n) AS selected_top20,
       score = e AS boundary_tie
FROM ranked JOIN edge USING (model, seed, segment) WHERE label = 1""")
def rank_audit_positives(spark: SparkSession, sf: str) -> DataFrame:
    return rank_audit(views.oof(spark, sf), ["model", "seed"]).select(
        "model", "seed", "segment", "row_id", F.round("score", 9).alias("score"), "rank_in_segment",
        "selected_top10", "selected_top20", "boundary_tie",
    )


@query("T2", f"""WITH {views.OBS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS r FROM obs)
SELECT segment, row_id, score, CAST(r AS INTEGER) AS position FROM ranked WHERE r <= 5""")
def head_per_segment(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_segment(views.observations(spark, sf), 5).select("segment", "row_id", "score", "position")


@query("T3", "SELECT o_orderkey AS row_id, o_totalprice AS x FROM orders ORDER BY abs(o_totalprice) DESC, o_orderkey LIMIT 10")
def largest_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.timed(spark, sf).select("row_id", "x")
    return rows.orderBy(F.abs("x").desc(), "row_id").limit(10)
