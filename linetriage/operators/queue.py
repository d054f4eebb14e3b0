"""The inspection queue: ranks, tiers, actions, reasons, pages and its own check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linetriage.functions.columns import any_of, count_if, finite
from linetriage.functions.sizing import join_same, small_table
from linetriage.operators.ordering import BUCKETS, find_cuts, rank_everywhere_and_within, with_buckets

# Tiers, actions, reasons, the queue's columns and the checked contract items.
TIERS = ("HIGH", "REVIEW", "STANDARD")
TIER_SHARES = (0.1, 0.2)
ACTION_UNVALIDATED = "usual_inspection_unvalidated_machine"
ACTION_OUT_OF_RANGE = "usual_inspection_ood"
ACTION_LABEL = "usual_inspection_label_unconfirmed"
ACTION_INPUT_ERROR = "usual_inspection_input_error"
ACTION_CONTRACT = "usual_inspection_contract_or_approval_unconfirmed"
QUEUE_COLUMNS = (
    "segment", "row_id", "risk_score", "ood_feature_count", "global_rank", "segment_rank", "priority", "ood_flag",
    "action",
)
CONTRACT_ITEMS = (
    "label_semantics", "target_unit", "product_shot_cavity_mapping", "feature_availability", "inspection_timing",
    "raw_units", "supplier_transform", "future_validation_data",
)
OOD_LIMIT = 3
PAGE_LIMIT = 100


def route_action(unvalidated: Sequence[str]) -> Column:
    """First rule that applies: segment not validated, out of range, label not confirmed."""
    return (
        F.when(F.col("segment").isin(list(unvalidated)), ACTION_UNVALIDATED)
        .when(F.col("ood_flag"), ACTION_OUT_OF_RANGE)
        .otherwise(ACTION_LABEL)
    )


def tier(rank: Column, rows: Column) -> Column:
    high, review = (F.ceil(F.lit(s) * rows) for s in TIER_SHARES)
    return F.when(rank <= high, TIERS[0]).when(rank <= review, TIERS[1]).otherwise(TIERS[2])


def build_queue(scored: DataFrame, unvalidated: Sequence[str]) -> DataFrame:
    """Queue over (segment, row_id, score, ood_feature_count); both ranks come from one shuffle."""
    base = scored.select("segment", "row_id", "score", "ood_feature_count")
    score = F.col("score")
    fault = F.raise_error(F.lit("risk scores must be finite in [0, 1]")).cast("double")
    checked = F.when(score.between(0, 1), score).otherwise(fault)
    return rank_everywhere_and_within(base, "segment").select(
        "segment", "row_id", checked.alias("risk_score"), "ood_feature_count",
        F.col("global_rank").cast("long").alias("global_rank"),
        F.col("segment_rank").cast("long").alias("segment_rank"),
        tier(F.col("segment_rank"), F.col("segment_rank_total")).alias("priority"),
        (F.col("ood_feature_count") >= OOD_LIMIT).alias("ood_flag"),
    ).withColumn("action", route_action(unvalidated)).select(*QUEUE_COLUMNS)


def queue_faults(queue: DataFrame, source: DataFrame, unvalidated: Sequence[str]) -> DataFrame:
    """One row per rule with the number of violations; all zero for a valid queue.

    A null breaks the rule that would compare it, and ``null_value`` counts the rows that hold any.
    """
    if tuple(queue.columns) != QUEUE_COLUMNS:
        raise ValueError(f"queue columns are {queue.columns}")
    sizes = small_table(queue.groupBy("segment").agg(F.count(F.lit(1)).alias("_rows")))
    total = queue.count()
    rows = join_same(queue, sizes, ["segment"], "left")

    def broken(condition: Column) -> Column:
        return count_if(F.coalesce(condition, F.lit(True)))

    # Ranks are contiguous when each of 1..n occurs once: n distinct values within [1, n].
    local = rows.agg(
        count_if(any_of([F.col(c).isNull() for c in QUEUE_COLUMNS])).alias("null_value"),
        broken(~finite(F.col("risk_score")) | (F.col("risk_score") < 0) | (F.col("risk_score") > 1)).alias("score"),
        broken(~F.col("global_rank").between(1, total)).alias("global_rank_range"),
        broken(~F.col("segment_rank").between(1, F.col("_rows"))).alias("segment_rank_range"),
        count_if(~F.col("priority").eqNullSafe(tier(F.col("segment_rank"), F.col("_rows")))).alias("tier"),
        broken(
            (F.col("ood_feature_count") < 0) | (F.col("ood_flag") != (F.col("ood_feature_count") >= OOD_LIMIT))
        ).alias("ood_flag"),
        count_if(~F.col("action").eqNullSafe(route_action(unvalidated))).alias("action"),
    )
    def repeats(keys: Sequence[str], name: str) -> DataFrame:
        counted = queue.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        return counted.agg(count_if(F.col("c") > 1).alias(name))

    sides = (
        queue.select("segment", "row_id", F.lit(1).alias("q"), F.lit(0).alias("s"))
        .unionByName(source.select("segment", "row_id", F.lit(0).alias("q"), F.lit(1).alias("s")))
        .groupBy("segment", "row_id").agg(F.sum("q").alias("q"), F.max("s").alias("s"))
        .agg(count_if(F.col("q") > 1).alias("duplicate_key"), count_if(F.col("s") == 0).alias("not_in_source"),
             count_if(F.col("q") == 0).alias("not_in_queue"))
    )
    parts = [
        local, repeats(["global_rank"], "global_rank_repeated"),
        repeats(["segment", "segment_rank"], "segment_rank_repeated"), _order_faults(queue), sides,
    ]
    return _as_rules(parts)


def _order_faults(queue: DataFrame) -> DataFrame:
    """Scores must not rise with the rank: compare neighbours inside rank blocks and across block ends.

    Rows that cannot be ordered (a null rank, no finite score) are counted by other rules and left out here.
    """
    queue = queue.where(F.col("global_rank").isNotNull() & finite(F.col("risk_score")))
    cuts = find_cuts(queue, "global_rank")
    blocks = with_buckets(queue.select("global_rank", "risk_score"), cuts, "global_rank")
    inside = Window.partitionBy(*BUCKETS).orderBy("global_rank")
    local = blocks.withColumn("_up", F.lag("risk_score").over(inside) < F.col("risk_score")).groupBy(*BUCKETS).agg(
        count_if(F.col("_up")).alias("_bad"), F.min_by("risk_score", "global_rank").alias("_first"),
        F.max_by("risk_score", "global_rank").alias("_last"),
    )
    across = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    return local.withColumn("_gap", F.lag("_last").over(across) < F.col("_first")).agg(
        (F.coalesce(F.sum("_bad"), F.lit(0)) + count_if(F.col("_gap"))).alias("score_order")
    )


def _as_rules(parts: Sequence[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        names = part.columns
        long = part.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("failed_rows")) for n in names
        ])).alias("_r")).select("_r.*")
        out = long if out is None else out.unionByName(long)
    return out


def decide(
    df: DataFrame, validated: Sequence[str], known: Sequence[str], statuses: dict[str, str] | None = None,
    healthy: bool = True, warnings: Sequence[str] = (),
) -> DataFrame:
    """Action and every reason behind it. A row without a valid score keeps no score and gets the error action."""
    states = {item: (statuses or {}).get(item, "unconfirmed") for item in CONTRACT_ITEMS}
    score = F.col("risk_score")
    valid = F.coalesce(
        finite(score) & score.between(0, 1) & F.col("segment").isin(list(known)) & F.col("ood_flag").isNotNull(),
        F.lit(False),
    )
    outside = ~F.coalesce(F.col("segment").isin(list(validated)), F.lit(False))
    flagged = F.coalesce(F.col("ood_flag"), F.lit(False))
    usable = valid if healthy else F.lit(False)
    fixed = ["research_only", "field_approval_unavailable"]
    fixed += [f"{item}_{state}" for item, state in states.items() if state != "confirmed"]
    fixed += ([] if healthy else ["model_unavailable_or_unverified"]) + list(warnings)
    reasons = F.array(
        *[F.lit(r) for r in fixed],
        F.when(outside, "unvalidated_machine"),
        F.when(flagged, "out_of_training_range"),
        F.when(~valid, "invalid_or_missing_prediction"),
    )
    last = ACTION_LABEL if states["label_semantics"] != "confirmed" else ACTION_CONTRACT
    return df.withColumns({
        "research_score": F.when(usable, score),
        "prediction_status": F.when(usable, "available").otherwise("not_produced"),
        "action": F.when(~usable, ACTION_INPUT_ERROR).when(outside, ACTION_UNVALIDATED)
        .when(flagged, ACTION_OUT_OF_RANGE).otherwise(last),
        "fallback_reasons": F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull()))),
    })


def with_identifiers(df: DataFrame, source_hash: str | Column, queue_hash: str | Column) -> DataFrame:
    """Stable ids: of the observation in its source, and of the prediction in its queue."""
    source = F.lit(source_hash) if isinstance(source_hash, str) else source_hash
    queue = F.lit(queue_hash) if isinstance(queue_hash, str) else queue_hash
    uid = F.sha2(F.concat_ws(":", source, F.col("segment"), F.col("row_id").cast("string")), 256)
    return df.withColumn("observation_uid", uid).withColumn(
        "prediction_id", F.sha2(F.concat(F.col("observation_uid"), queue), 256)
    )


def page(queue: DataFrame, offset: int = 0, limit: int = 30, segment: str | None = None) -> DataFrame:
    """Rows offset+1 .. offset+limit by stored rank: a filter the scan can use, not a sort."""
    if offset < 0 or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError("offset must be >= 0 and limit in 1..100")
    rank = "global_rank" if segment is None else "segment_rank"
    wanted = F.col(rank).between(offset + 1, offset + limit)
    return queue.where(wanted if segment is None else wanted & (F.col("segment") == segment))


def any_fault(faults: DataFrame) -> None:
    """Strict mode: raise on the first broken rule."""
    broken = faults.where(F.col("failed_rows") > 0).orderBy("rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['failed_rows']}" for r in broken))


