"""Choice of a candidate from its inner results: ordered tie-breaks, guarded routes, replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.sizing import small_table

# The selection routes.
ROUTES = ("baseline", "nested_recall", "nested_guarded", "nested_f1", "nested_high_recall")


def priority(order: Sequence[str], column: str = "candidate") -> Column:
    """Place of a candidate in the frozen order; an unknown candidate is an error."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(column))
    return F.when(place > 0, place).otherwise(
        F.raise_error(F.concat(F.lit("unknown candidate "), F.col(column))).cast("long")
    )


def best(table: DataFrame, keys: Sequence[str], metrics: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest metrics, compared in turn; the earlier candidate wins a full tie."""
    ranked = table.withColumn("_place", priority(order))
    goal = F.struct(*metrics, (-F.col("_place")).alias("_p"))
    others = [c for c in table.columns if c not in keys]
    return ranked.groupBy(*keys).agg(F.max_by(F.struct(*others), goal).alias("_b")).select(*keys, "_b.*")


def routes(table: DataFrame, keys: Sequence[str], reference: str, order: Sequence[str]) -> DataFrame:
    """Winner of every route. The guarded route may not lose average precision or AUC against the reference.

    table: keys, candidate, found, average_precision, roc_auc, inner_f1, f1_recall, high_recall_precision.
    """
    base = small_table(table.where(F.col("candidate") == reference).select(
        *keys, F.col("average_precision").alias("_ap"), F.col("roc_auc").alias("_auc")
    ))
    safe = (F.col("average_precision") >= F.col("_ap") - 1e-12) & (F.col("roc_auc") >= F.col("_auc") - 1e-12)
    guarded = table.join(base, list(keys)).where(safe).drop("_ap", "_auc")
    recall_goal = ["found", "average_precision"]
    winners = {
        "baseline": table.where(F.col("candidate") == reference),
        "nested_recall": best(table, keys, recall_goal, order),
        "nested_guarded": best(guarded, keys, recall_goal, order),
        "nested_f1": best(table, keys, ["inner_f1", "f1_recall"], order),
        "nested_high_recall": best(table, keys, ["high_recall_precision"], order),
    }
    out = None
    for name in ROUTES:
        part = winners[name].select(*keys, F.lit(name).alias("route"), F.col("candidate").alias("winner"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_routes(scores: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every row of each (keys, route) the score of the route's winner. scores: keys, candidate, ..., score."""
    table = small_table(chosen.select(*keys, "route", F.col("winner").alias("candidate")))
    return scores.join(table, [*keys, "candidate"])


def replay(stored: DataFrame, again: DataFrame, keys: Sequence[str], column: str = "candidate") -> DataFrame:
    """Choices that the recomputation does not confirm."""
    a = stored.select(*keys, F.col(column).alias("stored"))
    b = again.select(*keys, F.col(column).alias("again"))
    return a.join(b, list(keys), "full_outer").where(~F.col("stored").eqNullSafe(F.col("again")))
