"""Inspection budgets: who is selected, what the selection catches, and how ties at the cut matter.

A budget of fraction f in a scope of n rows takes ceil(f * n) rows by (score desc,
segment, row_id). The row at that rank is found first (``rows_at_rank``); everything
else compares rows with it, so no operator here sorts or shuffles all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import count_if, ratio
from linetriage.functions.sizing import small_table
from linetriage.operators.ordering import Cuts, find_cuts, rows_at_rank
from linetriage.operators.quality import ranking_quality, score_table

# Policy names and the scope that means every segment together.
PER_SEGMENT = "P_MACHINE"
GLOBAL = "P_GLOBAL"
ALL = "all"
POOLED = -1


def _checked(fractions: Sequence[float]) -> list[float]:
    if not fractions or any(not 0 < f <= 1 for f in fractions):
        raise ValueError("a budget fraction must be in (0, 1]")
    return list(fractions)


def boundaries(
    df: DataFrame, scope: Sequence[str], fractions: Sequence[float], cuts: Cuts | None = None
) -> DataFrame:
    """One row per (scope, fraction): n, k and the order keys of the last selected row."""
    wanted = {str(f): F.ceil(F.lit(float(f)) * F.col("n")) for f in _checked(fractions)}
    at = rows_at_rank(df, scope, wanted, cuts=cuts)
    found = at.select(
        *scope, F.col("rank_name").cast("double").alias("fraction"), "n", "k",
        F.col("score").alias("edge_score"), F.col("segment").alias("edge_segment"),
        F.col("row_id").alias("edge_row"),
    )
    return small_table(found)


def inside_at(score: str, segment: str | None, row: str) -> Column:
    """Row-local test: does the row come no later than the boundary row named by these columns?"""
    earlier = F.col("row_id") <= F.col(row)
    if segment is not None:
        earlier = (F.col("segment") < F.col(segment)) | ((F.col("segment") == F.col(segment)) & earlier)
    return (F.col("score") > F.col(score)) | ((F.col("score") == F.col(score)) & earlier)


def inside() -> Column:
    return inside_at("edge_score", "edge_segment", "edge_row")


def select(
    df: DataFrame, fraction: float = 0.1, policy: str = PER_SEGMENT, dims: Sequence[str] = (), out: str = "selected"
) -> DataFrame:
    """Mark the rows a budget takes, separately for each value of ``dims``."""
    if policy not in (PER_SEGMENT, GLOBAL):
        raise ValueError(f"unknown policy {policy}")
    scope = [*dims, "segment"] if policy == PER_SEGMENT else list(dims)
    bounds = boundaries(df, scope, [fraction]).drop("fraction", "n", "k")
    if scope:
        if "segment" in scope:
            bounds = bounds.drop("edge_segment").withColumn("edge_segment", F.col("segment"))
        marked = df.join(bounds, scope)
    else:
        edge = bounds.first()
        if edge is None:
            return df.withColumn(out, F.lit(False))
        marked = df.withColumns({c: F.lit(edge[c]) for c in ("edge_score", "edge_segment", "edge_row")})
    return marked.withColumn(out, inside()).drop("edge_score", "edge_segment", "edge_row")


def in_scopes(df: DataFrame, folds: bool, segments: bool = True) -> DataFrame:
    """Repeat each row for the scopes it belongs to: its fold and the pooled folds, its segment and all segments."""
    own = F.col("segment")
    scopes = F.array(F.lit(ALL), own) if segments else F.array(own)
    out = df.withColumn("scope", F.explode(scopes))
    fold = F.array(F.lit(POOLED), F.col("fold").cast("int")) if folds else F.array(F.lit(POOLED))
    return out.withColumn("scope_fold", F.explode(fold))


def policy_table(
    df: DataFrame,
    dims: Sequence[str] = ("model", "seed"),
    fractions: Sequence[float] = (0.1, 0.2),
    policies: Sequence[str] = (GLOBAL, PER_SEGMENT),
    folds: bool = True,
    group: str | None = "group_id",
    quality: bool = True,
) -> DataFrame:
    """Comparison grid: one row per dims x fold (-1 = pooled) x segment (or all) x policy x fraction.

    The score table of each scope is small next to the rows, and the budget of each
    scope is one boundary row, so the grid is one wide pass with map-side sums.
    """
    narrow = df.select(*dims, "segment", "row_id", "label", "score", *(["fold"] if folds else []),
                       *([group] if group else []))
    scoped = in_scopes(narrow, folds)
    keys = [*dims, "scope_fold", "scope"]
    cuts = find_cuts(narrow, "score", "row_id")
    bounds = boundaries(scoped, keys, fractions, cuts).select(
        *keys, "fraction", "edge_score", "edge_segment", "edge_row"
    )
    edges = bounds.groupBy(*keys).agg(
        F.collect_list(F.struct("fraction", "edge_score", "edge_segment", "edge_row")).alias("edges")
    ).withColumnRenamed("scope", "edge_scope")
    edges = small_table(edges)
    choices = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.col("scope" if p == GLOBAL else "segment").alias("edge_scope"))
        for p in policies
    ])
    offered = scoped.withColumn("choice", F.explode(choices)).select("*", "choice.*").drop("choice")
    tested = (
        offered.join(edges, [*dims, "scope_fold", "edge_scope"])
        .withColumn("edge", F.explode("edges"))
        .select(*keys, "policy", "segment", "row_id", "label", "score", "edge.*")
        .withColumn("selected", inside())
    )
    picked = tested.groupBy(*keys, "policy", "fraction").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").cast("long").alias("positives"),
        count_if(F.col("selected")).alias("k"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("label"))), F.lit(0)).cast("long").alias("found"),
    )
    out = picked.withColumns({
        "prevalence": ratio(F.col("positives"), F.col("rows")),
        "missed": F.col("positives") - F.col("found"),
        "selected_negative": F.col("k") - F.col("found"),
        "recall": ratio(F.col("found"), F.col("positives")),
        "precision": ratio(F.col("found"), F.col("k")),
        "lift": F.when(F.col("positives") > 0, ratio(
            F.col("found") * F.col("rows").cast("double"), F.col("k") * F.col("positives").cast("double"))),
    })
    if group:
        members = scoped.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups")), keys)
    if quality:
        out = out.join(ranking_quality(scoped, keys, cuts=cuts), keys)
    return out.withColumnsRenamed({"scope_fold": "fold", "scope": "segment"})


def derived_policy_metrics(table: DataFrame) -> DataFrame:
    """Confusion counts of a selection, with accuracy and F1 that follow from them."""
    tp, k, pos, n = (F.col(c) for c in ("found", "k", "positives", "rows"))
    fp = k - tp
    out = table.withColumns({
        "tp": tp, "fp": fp, "fn": pos - tp, "tn": n - pos - fp,
    })
    return out.withColumns({
        "f1": ratio(2 * tp, k + pos),
        "accuracy": ratio(F.col("tp") + F.col("tn"), n),
    })


def top_block(df: DataFrame, dims: Sequence[str], fractions: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """k = max(1, ceil(f * n)) best rows of each scope: found, recall, precision, lift."""
    return policy_table(
        df, dims, fractions, policies=(GLOBAL,), folds=False, group=None, quality=False
    ).drop("fold", "policy")


def tie_bounds(
    df: DataFrame, dims: Sequence[str] = ("model", "seed"), fractions: Sequence[float] = (0.1, 0.2),
    segments_only: bool = False,
) -> DataFrame:
    """What the cut would catch if rows tied at the boundary score were taken in the worst, average or best order."""
    narrow = df.select(*dims, "segment", "row_id", "label", "score")
    scope = F.array(F.col("segment")) if segments_only else F.array(F.lit(ALL), F.col("segment"))
    scoped = narrow.withColumn("scope", F.explode(scope))
    keys = [*dims, "scope"]
    cuts = find_cuts(narrow, "score", "row_id")
    bounds = boundaries(scoped, keys, fractions, cuts).select(*keys, "fraction", "k", "edge_score")
    at = score_table(scoped, keys).join(bounds, keys)
    above, tied = F.col("score") > F.col("edge_score"), F.col("score") == F.col("edge_score")
    zero = F.lit(0)
    summed = at.groupBy(*keys, "fraction", "k", F.col("edge_score").alias("boundary_score")).agg(
        F.sum(F.when(above, F.col("n")).otherwise(zero)).alias("above_rows"),
        F.sum(F.when(above, F.col("pos")).otherwise(zero)).alias("above_positives"),
        F.sum(F.when(tied, F.col("n")).otherwise(zero)).alias("tied_rows"),
        F.sum(F.when(tied, F.col("pos")).otherwise(zero)).alias("tied_positives"),
        F.count(F.lit(1)).alias("unique_scores"),
    )
    left = F.col("k") - F.col("above_rows")
    other = F.col("tied_rows") - F.col("tied_positives")
    return summed.withColumns({
        "remaining": left,
        "minimum_found": F.col("above_positives") + F.greatest(zero.cast("long"), left - other),
        "expected_found": F.col("above_positives") + ratio(left * F.col("tied_positives"), F.col("tied_rows")),
        "maximum_found": F.col("above_positives") + F.least(left, F.col("tied_positives")),
    }).withColumnRenamed("scope", "segment")


def tie_totals(bounds: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Tie bounds of per-segment budgets summed over segments."""
    return bounds.groupBy(*dims, "fraction").agg(
        F.sum("minimum_found").alias("tie_min_found"),
        F.sum("expected_found").alias("tie_expected_found"),
        F.sum("maximum_found").alias("tie_max_found"),
    ).withColumn("tie_sensitive", F.col("tie_min_found") != F.col("tie_max_found"))


def smallest_sufficient(
    table: DataFrame, runs: Sequence[str], accept: Column, fraction: str = "fraction"
) -> DataFrame:
    """Smallest budget fraction that meets ``accept`` in every run and whose average also does.

    ``accept`` is an expression over the table's metric columns; it is tested on each run
    and again on the mean of each metric over runs.
    """
    numbers = [c for c, t in table.dtypes if t in ("double", "bigint", "int") and c not in (*runs, fraction)]
    per_run = table.groupBy(fraction).agg(F.bool_and(accept).alias("every_run"))
    mean = table.groupBy(fraction).agg(*[F.avg(c).alias(c) for c in numbers]).select(
        fraction, accept.alias("mean_run")
    )
    verdict = per_run.join(mean, fraction)
    return verdict.agg(
        F.min(F.when(F.col("every_run") & F.col("mean_run"), F.col(fraction))).alias("recommended_fraction"),
        F.count(F.lit(1)).alias("fractions_tested"),
    )
