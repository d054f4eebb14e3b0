"""A nested selection as a stored run, and a verifier that recomputes it by a path of its own.

The verifier shares nothing with the run but running sums over score values: it takes the rows that had to be scored
from the rows and inner folds, counts every metric again from the stored scores by another formula, compares the
choices pair by pair and decides every row again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from linetriage.functions.columns import count_if, finite
from linetriage.functions.sizing import small_table
from linetriage.operators.models import NestedRun
from linetriage.operators.ordering import rank_rows, running_by_value
from linetriage.sources.sinks import save

TABLES = ("inner_scores", "outer_scores", "metrics", "choices", "decided")
SCOPE = ["outer", "segment", "candidate"]
CELLS = ("found", "average_precision", "roc_auc", "inner_f1", "f1_recall", "f1_threshold", "high_recall_threshold",
         "high_recall_precision")
TOLERANCE = 1e-12


def save_run(run: NestedRun, path: str) -> None:
    """Write the tables of a run below ``path``; an existing table is an error."""
    for name in [*TABLES, *(["ledger"] if run.ledger is not None else [])]:
        save(getattr(run, name), f"{path}/{name}")


def load_run(spark: SparkSession, path: str, ledger: bool = True) -> NestedRun:
    """The tables below ``path``; ``ledger``: the run was stored with its ledger of fits."""
    return NestedRun(**{name: spark.read.parquet(f"{path}/{name}") for name in [*TABLES, *(["ledger"] if ledger else [])]})


def _once_each(check: str, wanted: DataFrame, stored: DataFrame, keys: Sequence[str], facts: Sequence[str], good: Column) -> DataFrame:
    """Keys that are not on both sides exactly once with equal facts (null equals null), or whose stored row is not ``good``."""
    def side(df: DataFrame, want: int, fine: Column) -> DataFrame:
        return df.select(*keys, F.struct(*facts).alias("_f"), F.lit(want).alias("_want"), F.lit(1 - want).alias("_have"),
                         F.coalesce(fine, F.lit(False)).alias("_good"))

    both = side(wanted, 1, F.lit(True)).unionByName(side(stored, 0, good)).groupBy(*keys).agg(
        F.sum("_want").alias("w"), F.sum("_have").alias("h"), F.min("_f").alias("a"), F.max("_f").alias("b"), F.bool_and("_good").alias("g"))
    right = (F.col("w") == 1) & (F.col("h") == 1) & F.col("a").eqNullSafe(F.col("b")) & F.col("g")
    return both.agg(F.lit(check).alias("check"), F.count(F.lit(1)).alias("compared"), count_if(~right).alias("failed"))


def _score_is_one() -> Column:
    return finite(F.col("score")) & F.col("score").between(0.0, 1.0)


def _named(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    return df.withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in candidates])))


def check_inner_rows(run: NestedRun, rows: DataFrame, inner: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Every training row of every outer fold is scored once by every candidate, with its group, label and inner fold."""
    placed = rows.select("segment", "row_id", "group_id", "label", "fold").join(inner.select("outer", "group_id", "inner_fold"), "group_id")
    wanted = _named(placed.where(F.col("outer") != F.col("fold")), candidates)
    return _once_each("inner_rows", wanted, run.inner_scores, ["outer", "candidate", "segment", "row_id"],
                      ["group_id", "label", "inner_fold"], _score_is_one())


def check_outer_rows(run: NestedRun, rows: DataFrame, inner: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Every row is scored once by every candidate in its own outer fold."""
    wanted = _named(rows.select("segment", "row_id", "group_id", "label", F.col("fold").alias("outer")), candidates)
    return _once_each("outer_rows", wanted, run.outer_scores, ["candidate", "segment", "row_id"],
                      ["outer", "group_id", "label"], _score_is_one())


def check_metrics(run: NestedRun, rows: DataFrame, inner: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Every metric cell follows from the stored inner scores.

    AUC counts for each positive the negatives below it, F1 comes from counts, a threshold must reach the stored F1
    and no other may exceed it, and the high-recall threshold is the lowest score of a positive.
    """
    scores = run.inner_scores.select(*SCOPE, "row_id", "label", "score")
    table = running_by_value(scores, SCOPE, "score", {"n": F.lit(1), "y": F.col("label")})
    limits = small_table(run.metrics.select(*SCOPE, F.col("f1_threshold").alias("_at")))
    upto, caught = F.col("n_before") + F.col("n"), F.col("y_before") + F.col("y")
    below = (F.col("n_total") - F.col("y_total")) - (upto - caught)
    here = F.col("score") == F.col("_at")
    f1 = 2.0 * caught / (upto + F.col("y_total"))
    again = table.join(limits, SCOPE, "left").groupBy(*SCOPE).agg(
        (F.sum(F.col("y") * caught / upto) / F.max("y_total")).alias("average_precision"),
        (F.sum(F.col("y") * (below + (F.col("n") - F.col("y")) / 2.0)) / (F.max("y_total").cast("double") * (F.max("n_total") - F.max("y_total")))).alias("roc_auc"),
        F.max(f1).alias("inner_f1"), F.max(F.when(here, f1)).alias("_f1_there"),
        F.max(F.when(here, caught / F.col("y_total"))).alias("f1_recall"),
        F.min(F.when(F.col("y") > 0, F.col("score"))).alias("high_recall_threshold"),
        F.max(F.when(caught == F.col("y_total"), F.col("y_total") / upto)).alias("high_recall_precision"))
    sizes = small_table(scores.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_n")))
    spots = rank_rows(scores, SCOPE, ties=["segment", "row_id"]).join(sizes, SCOPE)
    found = spots.groupBy(*SCOPE).agg(F.sum(F.when(F.col("rank") <= F.ceil(F.col("_n") * F.lit(0.1)), F.col("label")).otherwise(0)).alias("found"))
    stored = run.metrics.select(*SCOPE, *[F.col(c).cast("double").alias(f"_{c}") for c in CELLS])
    both = stored.join(again.join(found, SCOPE), SCOPE, "full_outer").withColumn(
        "f1_threshold", F.when(F.abs(F.col("_f1_there") - F.col("inner_f1")) <= TOLERANCE, F.col("_f1_threshold")))
    right = [F.coalesce(F.abs(F.col(f"_{c}") - F.col(c)) <= TOLERANCE, F.lit(False)) for c in CELLS]
    cells = both.select(F.explode(F.array(*right)).alias("ok"))
    return cells.agg(F.lit("metrics").alias("check"), F.count(F.lit(1)).alias("compared"), count_if(~F.col("ok")).alias("failed"))


def check_choices(run: NestedRun, rows: DataFrame, inner: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Every route's winner follows from the stored metrics; the first candidate is the reference of the guarded route."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("candidate"))
    within = Window.partitionBy("outer", "segment")
    reference = [F.max(F.when(F.col("candidate") == candidates[0], F.col(c))).over(within) for c in ("average_precision", "roc_auc")]
    table = run.metrics.withColumns({"_place": place, "_ap": reference[0], "_auc": reference[1]})
    safe = (F.col("average_precision") >= F.col("_ap") - TOLERANCE) & (F.col("roc_auc") >= F.col("_auc") - TOLERANCE)
    rules = {
        "baseline": (F.col("candidate") == candidates[0], []), "nested_recall": (F.lit(True), ["found", "average_precision"]),
        "nested_guarded": (safe, ["found", "average_precision"]), "nested_f1": (F.lit(True), ["inner_f1", "f1_recall"]),
        "nested_high_recall": (F.lit(True), ["high_recall_precision"]),
    }
    parts = []
    for route, (admitted, goals) in rules.items():
        order = within.orderBy(*[F.desc(g) for g in goals], "_place")
        first = table.where(admitted).withColumn("_i", F.row_number().over(order)).where("_i = 1")
        parts.append(first.select("outer", "segment", F.lit(route).alias("route"), F.col("candidate").alias("winner")))
    return _once_each("choices", reduce(DataFrame.unionByName, parts), run.choices, ["outer", "segment", "route"], ["winner"], F.lit(True))


def check_decisions(run: NestedRun, rows: DataFrame, inner: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Every route's score is that of its stored winner, and every decision follows from the stored thresholds."""
    facts = ["candidate", "label", "score", "f1_decision", "high_recall_decision"]
    keys = ["outer", "segment", "route", "row_id"]
    limits = small_table(run.metrics.select(*SCOPE, "f1_threshold", "high_recall_threshold"))
    scored = run.outer_scores.join(limits, SCOPE, "left")
    winners = small_table(run.choices.select("outer", "segment", "route", F.col("winner").alias("candidate")))
    routed = scored.join(winners, SCOPE).select(
        *keys, "candidate", "label", "score", (F.col("score") >= F.col("f1_threshold")).alias("f1_decision"),
        (F.col("score") >= F.col("high_recall_threshold")).alias("high_recall_decision"))
    best = scored.groupBy("outer", "segment", "row_id", "label").agg(F.max(F.col("score") - F.col("high_recall_threshold")).alias("m"))
    reaches = F.col("m") >= 0
    united = best.select("outer", "segment", F.lit("union").alias("route"), "row_id", F.lit("union").alias("candidate"), "label",
                         ((F.col("m") + 1.0) / 2.0).alias("score"), reaches.alias("f1_decision"), reaches.alias("high_recall_decision"))
    return _once_each("decisions", routed.unionByName(united), run.decided, keys, facts, _score_is_one())


def check_ledger(run: NestedRun, rows: DataFrame, inner: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Every (outer fold, fold left out, candidate) was fitted on all other rows: their number and positives agree.

    A candidate may have one fit for all segments or one for each; the counts of its segments add up to the same.
    """
    counts = rows.groupBy("fold", "group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    placed = counts.join(inner.select("outer", "group_id", "inner_fold"), "group_id").where(F.col("outer") != F.col("fold"))
    cells = placed.groupBy("outer", F.col("inner_fold").alias("fold")).agg(F.sum("n").alias("n"), F.sum("y").alias("y")).unionByName(
        counts.groupBy(F.lit(-1).alias("outer"), "fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    whole = Window.partitionBy("outer")
    wanted = small_table(cells).select("outer", "fold", (F.sum("n").over(whole) - F.col("n")).alias("rows"), (F.sum("y").over(whole) - F.col("y")).alias("positives"))
    stored = run.ledger.groupBy(F.coalesce("outer", F.lit(-1)).alias("outer"), "fold", "candidate").agg(
        F.sum("training_rows").alias("rows"), F.sum("training_positives").alias("positives"))
    return _once_each("ledger", _named(wanted, candidates), stored, ["outer", "fold", "candidate"], ["rows", "positives"], F.lit(True))


CHECKS: dict[str, Callable[[NestedRun, DataFrame, DataFrame, Sequence[str]], DataFrame]] = {
    "inner_rows": check_inner_rows, "outer_rows": check_outer_rows, "metrics": check_metrics,
    "choices": check_choices, "decisions": check_decisions, "ledger": check_ledger,
}


def verify_run(run: NestedRun, rows: DataFrame, inner: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Per check: things compared and things that the recomputation does not confirm.

    ``rows`` and ``inner`` are those the run was made with; ``candidates`` in frozen order, the reference first.
    """
    checks = [check for name, check in CHECKS.items() if name != "ledger" or run.ledger is not None]
    return reduce(DataFrame.unionByName, [check(run, rows, inner, candidates) for check in checks])
