"""Groups of identical measurements: naming, audits, conflicts, collapse and weights.

A group of copies may hold a large share of all rows, so groups are always built by
map-side aggregation and given back to rows with ``attach``; no window runs over a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import count_if, ratio
from linetriage.functions.sizing import attach, small_table
from linetriage.operators.ordering import rows_at_rank


def group_name() -> Column:
    return F.concat_ws(":", F.col("segment"), F.min("row_id").cast("string"))


def group_table(df: DataFrame, features: Sequence[str], labelled: bool = True) -> DataFrame:
    """One row per (segment, feature values): name, rows, positives, stratum."""
    out = df.groupBy("segment", *features).agg(
        group_name().alias("group_id"),
        F.min("row_id").alias("first_row"),
        F.count(F.lit(1)).alias("group_rows"),
        *([F.sum("label").cast("long").alias("group_positives")] if labelled else []),
    )
    if not labelled:
        return out
    has = F.when(F.col("group_positives") > 0, "1").otherwise("0")
    return out.withColumn("stratum", F.concat_ws(":", "segment", has))


def with_groups(df: DataFrame, features: Sequence[str], labelled: bool = True) -> DataFrame:
    """Rows with the name and attributes of their group; names are exact, not hashes."""
    groups = group_table(df, features, labelled)
    return attach(df, groups, ["segment", *features], "group_rows")


def conflicting() -> Column:
    return (F.col("group_positives") > 0) & (F.col("group_positives") < F.col("group_rows"))


def row_attributes(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Conflict flag, group size and inverse-size weight with mean 1 on each row."""
    rows = with_groups(df, features)
    totals = group_table(df, features).agg(F.sum("group_rows").alias("r"), F.count(F.lit(1)).alias("g")).first()
    mean = (totals["g"] or 0) / totals["r"] if totals["r"] else 1.0
    return rows.withColumns({
        "conflict": conflicting(), "group_weight": (1.0 / F.col("group_rows")) / F.lit(float(mean)),
    })


def duplicate_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Groups, ambiguous groups, positives in them, errors no rule on these features can avoid."""
    g = group_table(df, features)
    pos, n = F.col("group_positives"), F.col("group_rows")
    return g.agg(
        F.sum(n).alias("rows"), F.sum(pos).alias("positives"), F.count(F.lit(1)).alias("groups"),
        count_if(conflicting()).alias("ambiguous_groups"),
        F.coalesce(F.sum(F.when(conflicting(), pos)), F.lit(0)).alias("ambiguous_positive_rows"),
        F.sum(F.least(pos, n - pos)).alias("irreducible_errors"),
        ratio(F.sum(pos), F.sum(n)).alias("prevalence"),
    )


def constant_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features with at most one value, from one pass of least and greatest values."""
    ends = df.agg(*[F.struct(F.min(f).alias("a"), F.max(f).alias("b")).alias(f) for f in features])
    flags = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}.a").eqNullSafe(F.col(f"{f}.b")).alias("constant"))
        for f in features
    ])
    return ends.select(F.explode(flags).alias("f")).select("f.*")


def segment_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per segment: rows, positives, groups, ambiguous groups, positives in the first and last fifth by row id."""
    wanted = {
        "early": F.greatest(F.lit(1), F.floor(F.lit(0.2) * F.col("n"))),
        "late": F.floor(F.lit(0.8) * F.col("n")),
    }
    marks = rows_at_rank(df, ["segment"], wanted, value="row_id", ties=("row_id",), descending=False)
    ends = small_table(marks.groupBy("segment").agg(*[
        F.max(F.when(F.col("rank_name") == name, F.col("row_id"))).alias(f"_{name}") for name in wanted
    ]))
    y = F.col("label")
    rows = df.join(ends, "segment").groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(y).cast("long").alias("positive_rows"),
        count_if((y == 1) & (F.col("row_id") <= F.col("_early"))).alias("first_fifth_positives"),
        count_if((y == 1) & (F.col("_late").isNull() | (F.col("row_id") > F.col("_late")))).alias(
            "last_fifth_positives"),
    )
    groups = group_table(df, features).groupBy("segment").agg(
        F.count(F.lit(1)).alias("groups"), count_if(F.col("group_positives") > 0).alias("positive_groups"),
        count_if(conflicting()).alias("ambiguous_groups"),
    )
    return rows.join(groups, "segment")


def conflict_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per segment: conflicting groups, positives in them, and how many groups have each size."""
    g = group_table(df, features)
    pos = F.col("group_positives")
    sizes = g.groupBy("segment", "group_rows").agg(
        F.count(F.lit(1)).alias("c"), F.sum(pos).alias("p"), count_if(conflicting()).alias("x"),
        F.coalesce(F.sum(F.when(conflicting(), pos)), F.lit(0)).alias("xp"),
    )
    entry = F.struct(F.col("group_rows").alias("size"), F.col("c").alias("groups"))
    return sizes.groupBy("segment").agg(
        F.sum(F.col("group_rows") * F.col("c")).alias("rows"), F.sum("p").alias("positive_rows"),
        F.sum("c").alias("groups"), F.sum("x").alias("conflicting_groups"),
        F.sum("xp").alias("positive_rows_in_conflicting_groups"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("group_size_counts"),
    )


def identifiability(df: DataFrame, features: Sequence[str], fraction: float = 0.1) -> DataFrame:
    """Best possible precision and F1 of any rule that sees only the features, at full recall and at a budget."""
    pos, n = F.col("group_positives"), F.col("group_rows")
    some = pos > 0
    sums = group_table(df, features).groupBy("segment").agg(
        F.sum(n).alias("rows"), F.sum(pos).alias("positives"),
        count_if(conflicting()).alias("conflicting_groups"),
        F.coalesce(F.sum(F.when(some, n - pos)), F.lit(0)).alias("unavoidable_false_positives"),
    )
    p, extra = F.col("positives"), F.col("unavoidable_false_positives")
    k = F.ceil(F.lit(fraction) * F.col("rows"))
    return sums.withColumns({
        "k": k,
        "precision_bound_full_recall": ratio(p, p + extra),
        "f1_bound_full_recall": ratio(2 * p, 2 * p + extra),
        "precision_bound_at_k": ratio(F.least(p, k), k),
        "f1_bound_at_k": ratio(2 * F.least(p, k), k + p),
    })


def collapse_events(df: DataFrame, features: Sequence[str], group: str = "group_id") -> DataFrame:
    """One row per group with label = any positive; different measurements in a group, a null beside a value too, are an error."""
    ends = [a(f).alias(f"_{k}_{f}") for f in features for k, a in (("a", F.min), ("b", F.max), ("n", F.count))]
    g = df.groupBy("segment", group).agg(
        F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("group_rows"),
        F.max("label").alias("label"), *ends,
    )
    def checked(f: str) -> Column:
        low, high = F.col(f"_a_{f}"), F.col(f"_b_{f}")
        fault = F.raise_error(F.concat(F.lit(f"group with different {f}: "), F.col(group)))
        whole = F.col(f"_n_{f}").isin(0) | (F.col(f"_n_{f}") == F.col("group_rows"))
        return F.when(low.eqNullSafe(high) & whole, low).otherwise(fault.cast("double")).alias(f)

    return g.select("segment", group, "row_id", "group_rows", "label", *[checked(f) for f in features])


def oversample(df: DataFrame, times: int) -> DataFrame:
    """Repeat positive rows for fitting only."""
    copies = F.when(F.col("label") == 1, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))
    return df.withColumn("copy", F.explode(copies))


def group_rollup(df: DataFrame, dims: Sequence[str], group: str = "group_id") -> DataFrame:
    """Events of a selection: groups, positive groups, and those with any or all rows selected."""
    keys = list(dims)
    per = df.groupBy(*keys, group).agg(
        F.max("label").alias("event"), F.bool_or("selected").alias("any_row"), F.bool_and("selected").alias("all_rows"),
        (F.max("score") - F.min("score")).alias("spread"),
    )
    event = F.col("event") == 1
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), count_if(event).alias("positive_groups"),
        count_if(F.col("any_row")).alias("groups_with_any_selected"),
        count_if(event & F.col("any_row")).alias("positive_groups_with_any_selected"),
        count_if(event & F.col("all_rows")).alias("positive_groups_with_all_selected"),
        F.max("spread").alias("largest_score_spread"),
    )
