"""Row-local derived columns. Everything here also runs unchanged on a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import add_up, finite, sigmoid
from linetriage.functions.sizing import attach, small_table

# Fixed value: least absolute denominator of an engineered ratio.
RATIO_FLOOR = 1e-8


def identity(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Project to the identity columns under new names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def model_matrix(df: DataFrame, features: Sequence[str], segment_value: str, drop: Sequence[str] = ()) -> DataFrame:
    """Features without the listed constants, plus a 0/1 column for one segment."""
    kept = [f for f in features if f not in drop]
    flag = F.when(F.col("segment") == segment_value, 1.0).otherwise(0.0)
    return df.select("segment", "row_id", *kept, flag.alias(f"segment_{segment_value}"))


def interactions(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    return df.withColumns({f"{f}_x_{flag}": F.col(f) * F.col(flag) for f in features})


def nonlinear(df: DataFrame, squares: Sequence[str], product: tuple[str, str]) -> DataFrame:
    a, b = product
    return df.withColumns({
        **{f"{f}_squared": F.col(f) * F.col(f) for f in squares}, f"{a}_x_{b}": F.col(a) * F.col(b),
    })


def engineered(
    df: DataFrame, ratios: Mapping[str, tuple[str, str]], spread: tuple[str, Sequence[str]],
    differences: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Ratios with a floored denominator, mean and spread over a family of columns, differences of pairs."""
    name, family = spread
    members = [F.col(c) for c in family]
    new: dict[str, Column] = {
        out: F.col(a) / F.greatest(F.abs(F.col(b)), F.lit(RATIO_FLOOR)) for out, (a, b) in ratios.items()
    }
    new[f"{name}_mean"] = add_up(members) / float(len(members))
    new[f"{name}_spread"] = F.greatest(*members) - F.least(*members)
    new.update({out: F.col(a) - F.col(b) for out, (a, b) in differences.items()})
    return df.withColumns(new)


def _aligned(table: DataFrame, keys: Sequence[str], features: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key with an array of structs in the order of ``features``, so a row's lookup is by position."""
    by_name = table.where(F.col("feature").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*fields)))).alias("_map")
    )
    names = F.array(*[F.lit(f) for f in features])
    return by_name.select(*keys, F.transform(names, lambda n: F.try_element_at("_map", n)).alias("_by_feature"))


def condition_bands(df: DataFrame, medians: DataFrame, features: Sequence[str]) -> DataFrame:
    """Side of the training median of the row's own (fold, segment)."""
    wide = small_table(_aligned(medians, ["fold", "segment"], features, ["median"]))
    joined = df.join(wide, ["fold", "segment"], "left")
    bands = {}
    for i, f in enumerate(features):
        median = F.col("_by_feature")[i]["median"]
        bands[f"band_{f}"] = F.when(F.col(f) <= median, "le_train_median").when(F.col(f) > median, "gt_train_median")
    return joined.withColumns(bands).drop("_by_feature")


def out_of_range(df: DataFrame, bounds: DataFrame, features: Sequence[str], limit: int = 3) -> DataFrame:
    """Count the features outside their segment's bounds and flag rows with ``limit`` or more."""
    wide = small_table(_aligned(bounds, ["segment"], features, ["low", "high"]))
    joined = df.join(wide, "segment", "left")
    outside = add_up([
        F.when((F.col(f) < F.col("_by_feature")[i]["low"]) | (F.col(f) > F.col("_by_feature")[i]["high"]), 1).otherwise(0)
        for i, f in enumerate(features)
    ])
    return joined.withColumn("ood_feature_count", outside).withColumn(
        "ood_flag", F.col("ood_feature_count") >= limit
    ).drop("_by_feature")


def linear_margin(df: DataFrame, weights: DataFrame, features: Sequence[str], out: str = "z") -> DataFrame:
    """Sum of (x - mean) / scale * coef + intercept with the row's segment weights.

    ``weights`` has segment, feature, mean, scale, coef; the intercept is the row whose
    feature is null. Rows of a segment without weights keep a null margin.
    """
    intercept = weights.where(F.col("feature").isNull()).select("segment", F.col("coef").alias("_intercept"))
    wide = _aligned(weights, ["segment"], features, ["mean", "scale", "coef"]).join(intercept, "segment")
    joined = df.join(small_table(wide), "segment", "left")
    terms = []
    for i, f in enumerate(features):
        w = F.col("_by_feature")[i]
        terms.append((F.col(f) - w["mean"]) / w["scale"] * w["coef"])
    return joined.withColumn(out, add_up([F.col("_intercept"), *terms])).drop("_intercept", "_by_feature")


def checked_sigmoid(z: Column) -> Column:
    """Logistic score; a margin that is not finite is an error, not a score."""
    return F.when(finite(z), sigmoid(z)).otherwise(
        F.raise_error(F.lit("input gives no finite model output; no score is produced")).cast("double")
    )


def linear_score(df: DataFrame, weights: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    scored = linear_margin(df, weights, features, "_z")
    return scored.withColumn(out, checked_sigmoid(F.col("_z"))).drop("_z")


def route_by_segment(df: DataFrame, columns: Mapping[str, str], default: str, out: str = "score") -> DataFrame:
    """Take the score column chosen for the row's segment, the default column elsewhere."""
    choice = F.col(default)
    for segment, column in columns.items():
        choice = F.when(F.col("segment") == segment, F.col(column)).otherwise(choice)
    return df.withColumn(out, choice)


def union_margin(df: DataFrame, thresholds: Mapping[str, float | Column]) -> DataFrame:
    """Best margin over candidates, as a score in [0, 1] and a decision."""
    margins = [F.col(c) - (t if isinstance(t, Column) else F.lit(t)) for c, t in thresholds.items()]
    best = F.greatest(*margins) if len(margins) > 1 else margins[0]
    return df.withColumn("_best", best).withColumns({
        "score": (F.col("_best") + 1.0) / 2.0, "decision": F.col("_best") >= 0,
    }).drop("_best")


def score_distinct(df: DataFrame, features: Sequence[str], score) -> DataFrame:
    """Apply ``score`` (a DataFrame function adding ``score``) once per distinct input and give it to every copy."""
    distinct = df.groupBy(*features).agg(F.count(F.lit(1)).alias("_copies"))
    scored = score(distinct).select(*features, "_copies", "score")
    return attach(df, scored, list(features), "_copies", sizes=distinct).drop("_copies")


def balanced_weights(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Class weight n / (2 * n_class), so both classes weigh the same in a fit; a null label is an error."""
    fault = F.raise_error(F.lit("a class weight needs a label")).cast(dict(df.dtypes)["label"])
    df = df.withColumn("label", F.coalesce(F.col("label"), fault))
    counts = df.groupBy(*scope, "label").agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*scope).agg(F.sum("_c").alias("_n")) if scope else None
    if totals is not None:
        table = counts.join(totals, list(scope))
    else:
        table = counts.withColumn("_n", F.lit(counts.agg(F.sum("_c")).first()[0]))
    weights = table.select(*scope, "label", (F.col("_n") / (2.0 * F.col("_c"))).alias("class_weight"))
    return df.join(small_table(weights), [*scope, "label"])
