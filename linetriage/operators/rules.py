"""Data-quality rules. Each gives rows (rule, failed_rows, first_key); ``strict`` turns a failure into an error.

Row rules of a table share one pass. Rules over groups are two-level aggregations, so a
large group costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import any_of, count_if, finite
from linetriage.functions.sizing import join_same, small_table

# Id range and labels a scoring batch may hold, and the request-size limit.
LARGEST_ID = 2**53 - 1
LABELS = (0, 1)
REQUEST_ROWS = 100_000
PARTITIONS = ("development", "holdout")


def strict(faults: DataFrame) -> DataFrame:
    broken = faults.where(F.col("failed_rows") > 0).orderBy("rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['failed_rows']} rows" for r in broken))
    return faults


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def _long(one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`.c").alias("failed_rows"), F.col(f"`{n}`.k").alias("first_key"))
        for n in names
    ])
    return one_row.select(F.explode(cells).alias("_r")).select("_r.*")


def check_rows(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One pass over the table; a rule is a condition that marks a bad row (null counts as bad)."""
    aggs = []
    for name, bad in rules.items():
        failed = F.coalesce(bad, F.lit(True))
        aggs.append(F.struct(
            count_if(failed).alias("c"), F.min(F.when(failed, key_text(keys))).alias("k")
        ).alias(name))
    return _long(df.agg(*aggs), list(rules))


def check_groups(
    df: DataFrame, group: Sequence[str], rules: Mapping[str, tuple[Column, Callable[[Column], Column]]]
) -> DataFrame:
    """Rules over groups: an aggregate and a test of its value that marks a bad group."""
    per = df.groupBy(*group).agg(*[a.alias(n) for n, (a, _) in rules.items()])
    aggs = []
    for name, (_, test) in rules.items():
        failed = F.coalesce(test(F.col(name)), F.lit(True))
        aggs.append(F.struct(
            count_if(failed).alias("c"), F.min(F.when(failed, key_text(group))).alias("k")
        ).alias(name))
    return _long(per.agg(*aggs), list(rules))


def label_domain(label: str = "label", allowed: Sequence[int] = LABELS) -> Column:
    return ~F.col(label).isin(list(allowed))


def not_finite(*columns: str) -> Column:
    return any_of([~finite(F.col(c).cast("double")) for c in columns])


def bad_score(score: str = "score") -> Column:
    return ~finite(F.col(score)) | (F.col(score) < 0) | (F.col(score) > 1)


def require_columns(df: DataFrame, names: Sequence[str], exact: bool = False) -> None:
    """Schema rule, checked on metadata only."""
    missing = [n for n in names if n not in df.columns]
    extra = [c for c in df.columns if c not in names] if exact else []
    twice = {c for c in df.columns if df.columns.count(c) > 1}
    if missing or extra or twice:
        raise ValueError(f"columns missing {missing}, not allowed {extra}, repeated {sorted(twice)}")


def require_same_features(*frames: DataFrame, ignore: Sequence[str] = ()) -> list[str]:
    lists = [[c for c in f.columns if c not in ignore] for f in frames]
    if any(x != lists[0] for x in lists):
        raise ValueError("inputs have different feature columns")
    return lists[0]


def require_numeric(df: DataFrame, features: Sequence[str]) -> None:
    kinds = dict(df.dtypes)
    wrong = [f for f in features if kinds[f] not in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if wrong:
        raise ValueError(f"features must be numeric, not text or boolean: {wrong}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    empty = any_of([F.col(k).isNull() for k in keys])
    nulls = check_rows(df, {"null_key": empty}, keys)
    repeats = check_groups(df, keys, {"duplicate_key": (F.count(F.lit(1)), lambda v: v > 1)})
    return nulls.unionByName(repeats)


def scoring_batch(df: DataFrame, features: Sequence[str], segments: Sequence[str], request: bool = False) -> DataFrame:
    """Contract of a batch to score. The row limit holds for request-sized calls, not for tables."""
    require_columns(df, ["segment", "row_id", *features], exact=True)
    require_numeric(df, ["row_id", *features])
    if request and df.limit(REQUEST_ROWS + 1).count() > REQUEST_ROWS:
        raise ValueError(f"a request holds at most {REQUEST_ROWS} rows")
    key = F.col("row_id").cast("double")
    rows = check_rows(df, {
        "unknown_segment": ~F.col("segment").isin(list(segments)),
        "id_range": (key < 0) | (key > LARGEST_ID) | (key != F.floor(key)),
        "not_finite": not_finite(*features),
    }, ["segment", "row_id"])
    return rows.unionByName(duplicate_keys(df, ["segment", "row_id"]))


def split_membership(manifest: DataFrame, folds: int) -> DataFrame:
    """Allowed partitions; fold range; each group in one partition and one fold."""
    part, fold = F.col("partition"), F.col("fold")
    rows = check_rows(manifest, {
        "partition_name": ~part.isin(list(PARTITIONS)),
        "development_fold": (part == PARTITIONS[0]) & (fold.isNull() | ~fold.between(0, folds - 1)),
        "holdout_fold": (part == PARTITIONS[1]) & fold.isNotNull(),
    }, ["segment", "row_id"])
    groups = check_groups(manifest, ["group_id"], {
        "group_in_partitions": (_more_than_one("partition"), lambda v: v),
        "group_in_folds": (_more_than_one("fold"), lambda v: v),
    })
    return rows.unionByName(groups)


def _more_than_one(column: str) -> Column:
    """Does the group hold two different values? (least < greatest, so no distinct sets are kept)"""
    return F.coalesce(F.min(column) < F.max(column), F.lit(False))


def _differ(column: str) -> Column:
    """Does the group hold two different values, or a null beside a value?"""
    some = F.count(column)
    return _more_than_one(column) | ((some > 0) & (some < F.count(F.lit(1))))


def leakage(fit: DataFrame, validation: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups present on both sides of a fit."""
    shared = fit.select(group).join(validation.select(group).distinct(), group, "left_semi").distinct()
    return shared.agg(F.struct(F.count(F.lit(1)).alias("c"), F.min(group).alias("k")).alias("shared_groups")).transform(
        lambda d: _long(d, ["shared_groups"])
    )


def fold_leakage(df: DataFrame, fold: str = "fold", group: str = "group_id") -> DataFrame:
    """Groups that lie in several folds, per fold: each would leak between fit and validation."""
    spread = df.groupBy(group, fold).agg(F.count(F.lit(1)).alias("rows"))
    leaked = spread.groupBy(group).agg((F.min(fold) < F.max(fold)).alias("leaks"))
    return spread.join(leaked, group).groupBy(fold).agg(
        F.sum("rows").alias("rows"), count_if(F.col("leaks")).alias("shared_groups")
    )


def fold_coverage(df: DataFrame) -> DataFrame:
    """Both classes must occur in every fold and segment."""
    return df.groupBy("fold", "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"),
        (F.min("label") < F.max("label")).alias("both_classes"),
    )


def group_integrity(df: DataFrame, features: Sequence[str], group: str = "group_id") -> DataFrame:
    """Same group, same measurements; a null beside a value is a difference."""
    return check_groups(df, [group], {f"differs_{f}": (_differ(f), lambda v: v) for f in features})


def score_spread(df: DataFrame, dims: Sequence[str], group: str = "group_id", tolerance: float = 1e-12) -> DataFrame:
    """Same group, same score: groups whose scores differ by more than the tolerance; a missing score is an error."""
    fault = F.raise_error(F.lit("a score is missing or not finite")).cast("double")
    score = F.when(finite(F.col("score")), F.col("score")).otherwise(fault)
    per = df.groupBy(*dims, group).agg((F.max(score) - F.min(score)).alias("s"))
    return per.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("groups"), count_if(F.col("s") > tolerance).alias("groups_with_spread"),
        F.max("s").alias("largest_spread"),
    )


def available_in_time(
    df: DataFrame, cutoff: str, ended: str, available: str, present: Sequence[str] = (), out: str = "in_time"
) -> DataFrame:
    """Point in time: the end and the arrival of every feature are no later than the cutoff. Works on a stream."""
    by_then = F.forall(F.map_values(available), lambda t: t <= F.col(cutoff))
    filled = F.lit(True)
    for c in present:
        filled = filled & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    some = F.size(available) > 0
    return df.withColumn(out, F.coalesce(filled & some & (F.col(ended) <= F.col(cutoff)) & by_then, F.lit(False)))


def with_zone(text: Column) -> Column:
    """Parse an ISO time that must carry a time zone; one without is an error."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.to_timestamp(text)).otherwise(
        F.raise_error(F.concat(F.lit("time zone required: "), text)).cast("timestamp")
    )


def oof_faults(oof: DataFrame, expected: DataFrame, models: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Check a long score table against the rows it must score.

    ``expected`` has the identity columns once per row; each must appear once per model and seed.
    """
    key = ["segment", "row_id"]
    identity = [c for c in expected.columns if c not in key]
    pair = ["model", "seed"]
    known = oof.where(F.col("model").isin(list(models)) & F.col("seed").isin(list(seeds)))
    rows = check_rows(oof, {
        "score_range": bad_score(),
        "unknown_pair": ~(F.col("model").isin(list(models)) & F.col("seed").isin(list(seeds))),
    }, [*pair, *key])
    repeats = check_groups(oof, [*pair, *key], {"duplicate_row": (F.count(F.lit(1)), lambda v: v > 1)})
    ours = known.groupBy(*key, *identity).agg(F.count(F.lit(1)).alias("_scored"))
    theirs = expected.withColumn("_want", F.lit(len(models) * len(seeds)))
    # A changed identity column makes a row that matches nothing on either side.
    both = join_same(
        theirs.select(*key, *identity, "_want"), ours.withColumn("_ours", F.lit(True)), [*key, *identity], "full_outer"
    )
    coverage = both.agg(
        F.struct(count_if(F.col("_ours").isNull()).alias("c"),
                 F.min(F.when(F.col("_ours").isNull(), key_text(key))).alias("k")).alias("never_scored"),
        F.struct(count_if(F.col("_want").isNull()).alias("c"), F.lit(None).cast("string").alias("k")).alias(
            "identity_differs"),
        F.struct(count_if(F.col("_scored") != F.col("_want")).alias("c"),
                 F.min(F.when(F.col("_scored") != F.col("_want"), key_text(key))).alias("k")).alias("incomplete_pairs"),
    )
    return rows.unionByName(repeats).unionByName(_long(coverage, ["never_scored", "identity_differs", "incomplete_pairs"]))


def cohort(df: DataFrame, group: str = "group_id") -> DataFrame:
    """Frozen facts of a cohort: rows, positives, groups and distinct folds per segment."""
    groups = df.groupBy("segment", group).agg(F.count(F.lit(1)).alias("r"), F.sum("label").alias("p"))
    facts = groups.groupBy("segment").agg(
        F.sum("r").alias("rows"), F.sum("p").alias("positives"), F.count(F.lit(1)).alias("groups"),
    )
    folds = df.groupBy("segment", "fold").agg(F.count(F.lit(1)).alias("r")).groupBy("segment").agg(
        F.count("fold").alias("folds")
    )
    return join_same(facts, folds, ["segment"])


def cohort_differences(df: DataFrame, contract: DataFrame, keys: Sequence[str] = ("segment",)) -> DataFrame:
    """Facts that differ from the contract, as (keys, fact, expected, actual)."""
    facts = [c for c in contract.columns if c not in keys]
    a = small_table(contract).select(*keys, *[F.col(f).alias(f"_want_{f}") for f in facts])
    joined = df.join(a, list(keys), "full_outer")
    cells = F.array(*[
        F.struct(F.lit(f).alias("fact"), F.col(f"_want_{f}").cast("double").alias("expected"),
                 F.col(f).cast("double").alias("actual")) for f in facts
    ])
    long = joined.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
    return long.where(~F.col("expected").eqNullSafe(F.col("actual")))


def ledger_gaps(observed: DataFrame, dimensions: Mapping[str, Sequence]) -> DataFrame:
    """Missing and unexpected entries of a work ledger; expected entries are the product of the dimension lists."""
    names = list(dimensions)
    expected = observed.sparkSession.range(1).select()
    for name, values in dimensions.items():
        expected = expected.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    seen = observed.select(*names)
    missing = expected.exceptAll(seen.distinct()).withColumn("fault", F.lit("missing"))
    extra = seen.exceptAll(expected).withColumn("fault", F.lit("unexpected"))
    return missing.unionByName(extra)


def ledger_counts(fits: DataFrame, cohort_sizes: DataFrame, keys: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Ledger entries whose recorded counts differ from the recomputed ones."""
    want = cohort_sizes.select(*keys, *[F.col(f).alias(f"_want_{f}") for f in facts])
    differs = any_of([~F.col(f).eqNullSafe(F.col(f"_want_{f}")) for f in facts])
    return fits.join(want, list(keys), "left").where(differs)


def decision_faults(
    rows: DataFrame, thresholds: DataFrame, keys: Sequence[str], decision: str = "decision"
) -> DataFrame:
    """Stored decisions that differ from score >= threshold, per key."""
    joined = rows.join(small_table(thresholds.select(*keys, "threshold")), list(keys), "left")
    again = F.col("score") >= F.col("threshold")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), count_if(~F.col(decision).eqNullSafe(again)).alias("failed_rows"),
    )


def _metric_cells(saved: DataFrame, again: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    metrics = [c for c in saved.columns if c not in keys]
    b = again.select(*keys, *[F.col(m).alias(f"_again_{m}") for m in metrics])
    joined = join_same(saved, b, list(keys), "full_outer")
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("saved"),
                 F.col(f"_again_{m}").cast("double").alias("again")) for m in metrics
    ])
    long = joined.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
    close = F.coalesce(F.abs(F.col("saved") - F.col("again")) <= tolerance, F.lit(False))
    return long.withColumn("failed", ~(close | F.col("saved").eqNullSafe(F.col("again"))))


def metric_faults(saved: DataFrame, again: DataFrame, keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Metric cells that a recomputation does not confirm, as (keys, metric, saved, again)."""
    return _metric_cells(saved, again, keys, tolerance).where("failed").drop("failed")


def metric_replay(saved: DataFrame, again: DataFrame, keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Per metric: cells compared and cells that differ."""
    return _metric_cells(saved, again, keys, tolerance).groupBy("metric").agg(
        F.count(F.lit(1)).alias("cells"), count_if(F.col("failed")).alias("failed_cells")
    )


def comparable(a: DataFrame, b: DataFrame, keys: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Cohort and budget facts that must be equal before two models are compared; one row per key."""
    right = b.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in facts])
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f).eqNullSafe(F.col(f"_b_{f}"))
    return a.join(right, list(keys), "full_outer").select(*keys, same.alias("comparable"))


def submission_faults(
    candidate: DataFrame, reference: DataFrame, id_column: str, predictions: Sequence[str],
    numeric: Sequence[str] = (), allowed: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Check an all-text submission against its reference file.

    Both frames carry ``line``, the position in their file; row order is compared on it.
    """
    columns = [c for c in candidate.columns if c != "line"]
    wanted = [c for c in reference.columns if c != "line"]
    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(c) == "")

    rules = {"blank_id": blank(id_column)}
    for c in predictions:
        rules[f"blank_{c}"] = blank(c)
        if c in numeric:
            rules[f"not_numeric_{c}"] = ~finite(F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)"))
        if allowed and c in allowed:
            rules[f"not_allowed_{c}"] = ~F.col(c).isin([str(v) for v in allowed[c]])
    rows = check_rows(candidate, rules, [id_column])
    repeats = check_groups(candidate, [id_column], {"duplicate_id": (F.count(F.lit(1)), lambda v: v > 1)})
    order = candidate.select("line", F.col(id_column).alias("a")).join(
        reference.select("line", F.col(id_column).alias("b")), "line", "full_outer"
    )
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    missing = F.col("a").isNull() != F.col("b").isNull()
    placed = order.agg(
        F.struct(count_if(differs).alias("c"), F.min(F.when(differs, F.coalesce("a", "b"))).alias("k")).alias("id_order"),
        F.struct(count_if(missing).alias("c"), F.min(F.when(missing, F.coalesce("a", "b"))).alias("k")).alias("row_count"),
    )
    schema = candidate.sparkSession.range(1).select(
        F.lit("columns").alias("rule"), F.lit(0 if columns == wanted else 1).cast("long").alias("failed_rows"),
        F.lit(None).cast("string").alias("first_key"),
    )
    return rows.unionByName(repeats).unionByName(_long(placed, ["id_order", "row_count"])).unionByName(schema)
