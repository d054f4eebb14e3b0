"""Exact ranks and running totals without putting a whole segment in one task.

A window over a segment (or over everything) is one task per segment. Here the order
key is cut at literal quantile points first, so a window partition holds one bucket of
one scope, and the rows before the bucket come from a per-bucket count. Cut points only
steer balance: any cut points give the same ranks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from linetriage.functions.columns import hash_number
from linetriage.functions.sizing import small_table
from linetriage.session import bucket_count

BUCKETS = ["_bucket", "_tie_name", "_tie_bucket"]


@dataclass(frozen=True)
class Cuts:
    """Split points of the order value, the buckets that hold one repeated value, split points of the tie key."""

    splits: tuple[float, ...]
    heavy: tuple[int, ...]
    tie_splits: tuple[float, ...]


def find_cuts(df: DataFrame, value: str, tie: str | None = None, buckets: int | None = None) -> Cuts:
    count = buckets or bucket_count(df.sparkSession)
    shares = [i / count for i in range(1, count)]
    accuracy = max(10_000, 10 * count)
    wanted = [F.percentile_approx(F.col(value).cast("double"), shares, accuracy).alias("value")]
    if tie:
        wanted.append(F.percentile_approx(F.col(tie).cast("double"), shares, accuracy).alias("tie"))
    found = df.agg(*wanted).first()
    points = [float(p) for p in (found["value"] or []) if math.isfinite(p)]
    repeated = _repeated(points)
    splits = sorted({*points, *[math.nextafter(p, math.inf) for p in repeated]})
    heavy = tuple(splits.index(p) + 1 for p in sorted(repeated))
    ties = tuple(sorted({float(p) for p in (found["tie"] or [])})) if tie else ()
    return Cuts(tuple(splits), heavy, ties)


def _repeated(points: Sequence[float]) -> set[float]:
    ordered = sorted(points)
    return {a for a, b in zip(ordered, ordered[1:]) if a == b}


def _cut(df: DataFrame, value: Column, splits: Sequence[float], out: str) -> DataFrame:
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    step = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol="_cut_in", outputCol=out, handleInvalid="keep"
    )
    return step.transform(df.withColumn("_cut_in", value.cast("double"))).drop("_cut_in")


def with_buckets(df: DataFrame, cuts: Cuts, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add the bucket columns. A value that fills whole buckets is cut further by its tie keys.

    A value without a place in the order (null or NaN) is an error, never a dropped row. Scope
    columns are joined on and must not be null either.
    """
    kind = dict(df.dtypes)[value]
    fault = F.raise_error(F.lit(f"{value} is null or NaN and cannot be ordered")).cast(kind)
    # One reference to the value: filters that Spark derives from it are inlined into its expression.
    known = F.nanvl(F.col(value), F.lit(None).cast(kind)) if kind in ("double", "float") else F.col(value)
    df = df.withColumn(value, F.coalesce(known, fault))
    out = _cut(df, F.col(value), cuts.splits, "_bucket")
    if not cuts.heavy or not ties:
        return out.withColumns({"_tie_name": F.lit(""), "_tie_bucket": F.lit(0.0)})
    is_heavy = F.col("_bucket").isin([float(b) for b in cuts.heavy])
    out = _cut(out, F.col(ties[-1]), cuts.tie_splits, "_tie_bucket")
    name = F.col(ties[0]).cast("string") if len(ties) > 1 else F.lit("")
    return out.withColumns({
        "_tie_name": F.when(is_heavy, name).otherwise(F.lit("")),
        "_tie_bucket": F.when(is_heavy, F.col("_tie_bucket")).otherwise(F.lit(0.0)),
    })


def _bucket_order(descending: bool) -> list[Column]:
    first = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    return [first, F.col("_tie_name").asc(), F.col("_tie_bucket").asc()]


def _offsets(
    df: DataFrame, scope: Sequence[str], buckets: Sequence[str], bucket_order: Sequence[Column],
    sums: Mapping[str, Column], few_scopes: bool,
) -> DataFrame:
    """Per (scope, bucket): totals of the earlier buckets and of the whole scope. One row per bucket, from partial sums."""
    totals = df.groupBy(*scope, *buckets).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    whole = Window.partitionBy(*(scope or [F.lit(0)]))
    earlier = whole.orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    out = totals.select(
        *scope, *buckets,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums],
    )
    return small_table(out) if few_scopes else out


def running(
    df: DataFrame,
    scope: Sequence[str],
    buckets: Sequence[str],
    bucket_order: Sequence[Column],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    few_scopes: bool = True,
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Add, for each name in ``sums``, ``name_before`` (rows of the scope strictly before) and ``name_total``.

    With few scopes the per-bucket totals are a small table and are broadcast after a size check;
    with many (one per bootstrap draw, say) they join on the partitioning the window already has.
    """
    keys = [*scope, *buckets]
    if offsets is None:
        offsets = _offsets(df, scope, buckets, bucket_order, sums, few_scopes)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"_in_{n}": F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in sums.items()})
    joined = local.join(offsets, keys)
    return joined.withColumns({f"{n}_before": F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in sums}).drop(
        *[f"_in_{n}" for n in sums], *[f"_off_{n}" for n in sums]
    )


def running_by_value(
    rows: DataFrame,
    scope: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    descending: bool = True,
    cuts: Cuts | None = None,
    few_scopes: bool = True,
) -> DataFrame:
    """One row per (scope, value): each sum over the value's rows, over all earlier values, and over the scope.

    Cut points and bucket totals come straight from the rows with map-side sums; only the
    per-value table is shuffled for the window.
    """
    cuts = cuts or find_cuts(rows, value)
    ready = with_buckets(rows, cuts, value)
    bucket_order = _bucket_order(descending)
    offsets = _offsets(ready, scope, BUCKETS, bucket_order, sums, few_scopes)
    table = ready.groupBy(*scope, *BUCKETS, value).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    own = {n: F.col(n) for n in sums}
    return running(table, scope, BUCKETS, bucket_order, order, own, few_scopes, offsets).drop(*BUCKETS)


def rank_rows(
    df: DataFrame,
    scope: Sequence[str],
    value: str = "score",
    ties: Sequence[str] = ("segment", "row_id"),
    out: str = "rank",
    descending: bool = True,
    cuts: Cuts | None = None,
) -> DataFrame:
    """1-based position of each row in its scope, by value and then the tie keys (text then number, or number)."""
    cuts = cuts or find_cuts(df, value, ties[-1])
    order = [F.col(value).desc() if descending else F.col(value).asc(), *[F.col(t).asc() for t in ties]]
    ready = with_buckets(df, cuts, value, ties)
    ranked = running(ready, scope, BUCKETS, _bucket_order(descending), order, {"_r": F.lit(1)})
    return ranked.withColumn(out, F.col("_r_before") + 1).drop("_r_before", "_r_total", *BUCKETS)


def rank_everywhere_and_within(
    df: DataFrame, inner: str, value: str = "score", ties: Sequence[str] = ("segment", "row_id"),
    outs: Sequence[str] = ("global_rank", "segment_rank"),
) -> DataFrame:
    """Rank over all rows and rank within ``inner`` from one shuffle: both windows use the same buckets.

    Also keeps the row count of the inner scope as ``<rank>_total``.
    """
    cuts = find_cuts(df, value, ties[-1])
    ready = with_buckets(df, cuts, value, ties)
    order = [F.col(value).desc(), *[F.col(t).asc() for t in ties]]
    # One count per (inner, bucket) serves both scopes.
    counts = small_table(ready.groupBy(inner, *BUCKETS).agg(F.count(F.lit(1)).alias("_c")))
    for scope, out in (([], outs[0]), ([inner], outs[1])):
        offsets = _offsets(counts, scope, BUCKETS, _bucket_order(True), {out: F.col("_c")}, True)
        ready = running(ready, scope, BUCKETS, _bucket_order(True), order, {out: F.lit(1)}, offsets=offsets)
    return ready.withColumns({out: F.col(f"{out}_before") + 1 for out in outs}).drop(
        f"{outs[0]}_total", *[f"{out}_before" for out in outs], *BUCKETS
    )


def rank_by_hash(df: DataFrame, scope: Sequence[str], text: str, tie: str, out: str) -> DataFrame:
    """1-based position by a hash text. Hash values spread evenly, so the cut points need no look at the data."""
    count = bucket_count(df.sparkSession)
    lead = hash_number(F.col(text), digits=8)
    ready = df.withColumn("_bucket", F.floor(lead * F.lit(count) / F.lit(2.0**32)))
    ranked = running(
        ready, scope, ["_bucket"], [F.col("_bucket").asc()],
        [F.col(text).asc(), F.col(tie).asc()], {"_r": F.lit(1)},
    )
    return ranked.withColumn(out, F.col("_r_before") + 1).withColumnRenamed("_r_total", f"{out}_total").drop(
        "_r_before", "_bucket"
    )


def rows_at_rank(
    df: DataFrame,
    scope: Sequence[str],
    wanted: Mapping[str, Column],
    value: str = "score",
    ties: Sequence[str] = ("segment", "row_id"),
    keep: Sequence[str] = (),
    descending: bool = True,
    cuts: Cuts | None = None,
) -> DataFrame:
    """The row at a wanted rank in each scope, found without sorting the scope.

    ``wanted`` names one or more ranks as expressions of the scope's row count ``n``.
    Counting per bucket tells which bucket holds the rank; only that bucket is sorted.
    Returns scope, rank_name, n, k and the order keys of the row.
    """
    cuts = cuts or find_cuts(df, value, ties[-1])
    kept = list(dict.fromkeys([*scope, value, *ties, *keep]))
    ready = with_buckets(df.select(*kept), cuts, value, ties)
    whole = Window.partitionBy(*(scope or [F.lit(0)]))
    earlier = whole.orderBy(*_bucket_order(descending)).rowsBetween(Window.unboundedPreceding, -1)
    counts = ready.groupBy(*scope, *BUCKETS).agg(F.count(F.lit(1)).alias("_rows"))
    placed = counts.withColumns({
        "n": F.sum("_rows").over(whole),
        "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
    })
    ranks = F.array(*[
        F.struct(F.lit(name).alias("rank_name"), rank.cast("long").alias("k")) for name, rank in wanted.items()
    ])
    targets = (
        placed.withColumn("_want", F.explode(ranks)).select("*", "_want.*").drop("_want")
        .where((F.col("k") > F.col("_before")) & (F.col("k") <= F.col("_before") + F.col("_rows")))
        .select(*scope, *BUCKETS, "rank_name", "n", "k", "_before")
    )
    order = [F.col(value).desc() if descending else F.col(value).asc(), *[F.col(t).asc() for t in ties]]
    candidates = ready.join(small_table(targets), [*scope, *BUCKETS])
    inside = Window.partitionBy(*scope, "rank_name", *BUCKETS).orderBy(*order)
    return (
        candidates.withColumn("_at", F.row_number().over(inside) + F.col("_before"))
        .where(F.col("_at") == F.col("k")).drop("_at", "_before", *BUCKETS)
    )


def previous_row(
    df: DataFrame, scope: Sequence[str], value: str, tie: str, take: Sequence[str], prefix: str = "previous_"
) -> DataFrame:
    """Columns of the row just before in (value, tie) order within each scope, null for the first row.

    Buckets are ordered; the first row of a bucket takes the last row of the latest bucket before it.
    """
    cuts = find_cuts(df, value, tie)
    ready = with_buckets(df, cuts, value, (tie,))
    keys = [*scope, *BUCKETS]
    row = F.struct(*take)
    inside = Window.partitionBy(*keys).orderBy(value, tie)
    lasts = ready.groupBy(*keys).agg(F.max_by(row, F.struct(value, tie)).alias("_last"))
    across = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(*_bucket_order(False))
    carried = small_table(lasts.select(*keys, F.lag("_last").over(across).alias("_carried")))
    joined = ready.withColumn("_near", F.lag(row).over(inside)).join(carried, keys)
    found = joined.withColumn("_found", F.coalesce("_near", "_carried"))
    return found.withColumns({f"{prefix}{c}": F.col(f"_found.{c}") for c in take}).drop(
        "_near", "_carried", "_found", *BUCKETS
    )
