"""Quality of scores: ranking metrics, probability metrics, confusion counts, reliability, slices, curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import count_if, finite, ratio, ratio_or_zero
from linetriage.operators.ordering import Cuts, running_by_value
from linetriage.operators.quantiles import quantiles

# Edges of the reliability bins and the clip of log-loss probabilities.
RELIABILITY_EDGES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
PROBABILITY_CLIP = 2.220446049250313e-16


def score_table(df: DataFrame, scope: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows and positives per distinct score: the input of every ranking metric."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*scope, "score").agg(F.sum(w).alias("n"), F.sum(w * F.col("label")).alias("pos"))


def cumulative(
    df: DataFrame, scope: Sequence[str], weight: Column | None = None, cuts: Cuts | None = None,
    few_scopes: bool = True,
) -> DataFrame:
    """Score table of labelled rows with the rows and positives of all higher scores and of the scope."""
    w = F.lit(1) if weight is None else weight
    sums = {"n": w, "pos": w * F.col("label")}
    return running_by_value(df, scope, "score", sums, cuts=cuts, few_scopes=few_scopes)


def quality_of_cumulative(table: DataFrame, scope: Sequence[str]) -> DataFrame:
    n, pos = F.col("n"), F.col("pos")
    neg, neg_before = n - pos, F.col("n_before") - F.col("pos_before")
    steps = table.groupBy(*scope).agg(
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_q"),
        F.sum(pos * ratio(F.col("pos_before") + pos, F.col("n_before") + n)).alias("_ap"),
        F.sum(pos.cast("double") * (neg_before + 0.5 * neg)).alias("_wrong"),
    )
    both = F.col("_p").cast("double") * F.col("_q")
    return steps.select(
        *scope,
        ratio(F.col("_ap"), F.col("_p")).alias("average_precision"),
        (1.0 - ratio(F.col("_wrong"), both)).alias("roc_auc"),
    )


def ranking_quality(
    df: DataFrame, scope: Sequence[str], weight: Column | None = None, cuts: Cuts | None = None
) -> DataFrame:
    """Average precision (a step per distinct score) and ROC-AUC (ties count half), null when undefined."""
    return quality_of_cumulative(cumulative(df, scope, weight, cuts), scope)


def probability_quality(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    y, p = F.col("label"), F.col("score")
    safe = F.greatest(F.lit(PROBABILITY_CLIP), F.least(F.lit(1.0 - PROBABILITY_CLIP), p))
    alert = p >= 0.5
    return df.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(safe) + (1 - y) * F.log(1.0 - safe))).alias("log_loss"),
        F.avg(p).alias("mean_probability"),
        ratio_or_zero(
            2 * count_if(alert & (y == 1)), count_if(alert) + count_if(y == 1)
        ).alias("f1_at_0_5"),
    )


def reliability(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Observed rate per score bin; a score of 1 falls in the last bin and empty bins stay, with null means.

    A null, NaN or infinite score is an error.
    """
    edges = RELIABILITY_EDGES
    fault = F.raise_error(F.lit("a score is missing or not finite")).cast("int")
    spot = F.lit(0)
    for i, low in enumerate(edges[1:-1], start=1):
        spot = F.when(F.col("score") >= low, F.lit(i)).otherwise(spot)
    filled = df.withColumn("bin", F.when(finite(F.col("score")), spot).otherwise(fault)).groupBy(*scope, "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("label1"),
        F.avg("score").alias("mean_probability"), F.avg("label").alias("observed_rate"),
    )
    bins = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(a).alias("low"), F.lit(b).alias("high"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ])
    frame = df.select(*scope).distinct().withColumn("_b", F.explode(bins)).select(*scope, "_b.*")
    joined = frame.join(filled, [*scope, "bin"], "left")
    return joined.fillna(0, subset=["rows", "label1"])



def confusion(df: DataFrame, scope: Sequence[str], decision: str = "decision") -> DataFrame:
    """Counts of a yes/no decision; here a zero denominator gives 0, unlike the ranking metrics."""
    hit, yes = F.col("label") == 1, F.col(decision)
    counts = df.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("rows"), count_if(hit).alias("positives"), count_if(yes).alias("k"),
        count_if(hit & yes).alias("tp"), count_if(~hit & yes).alias("fp"),
        count_if(hit & ~yes).alias("fn"), count_if(~hit & ~yes).alias("tn"),
    )
    tp = F.col("tp")
    return counts.withColumns({
        "recall": ratio_or_zero(tp, tp + F.col("fn")),
        "precision": ratio_or_zero(tp, tp + F.col("fp")),
        "f1": ratio_or_zero(2 * tp, 2 * tp + F.col("fp") + F.col("fn")),
        "accuracy": ratio_or_zero(tp + F.col("tn"), F.col("rows")),
    })


def slices(
    df: DataFrame, conditions: Mapping[str, Sequence[str]], alert: str = "alert", group: str = "group_id",
    small: int = 10,
) -> DataFrame:
    """Errors per (segment, condition, bands). A condition over several columns is a joint slice; null bands stay."""
    picks = F.array(*[
        F.struct(
            F.lit(name).alias("condition"),
            F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]).alias("bands"),
        )
        for name, columns in conditions.items()
    ])
    keys = ["segment", "condition", "bands"]
    long = df.select("segment", "label", alert, group, F.explode(picks).alias("_s")).select("*", "_s.*")
    hit, yes = F.col("label") == 1, F.col(alert)
    per_group = long.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("r"),
        count_if(hit & yes).alias("tp"), count_if(hit & ~yes).alias("fn"),
        count_if(~hit & yes).alias("fp"), count_if(~hit & ~yes).alias("tn"),
    )
    counts = per_group.groupBy(*keys).agg(
        F.sum("r").alias("rows"), F.count(F.lit(1)).alias("feature_groups"),
        *[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")],
    )
    return counts.withColumns({
        "positive_rows": F.col("tp") + F.col("fn"),
        "false_negative_rate": ratio(F.col("fn"), F.col("tp") + F.col("fn")),
        "false_positive_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
        "small_positive_sample": F.col("tp") + F.col("fn") < small,
    })


def fold_slices(df: DataFrame, conditions: Mapping[str, str], top: str = "top") -> DataFrame:
    """Per fold, segment, condition and side of the training median: rows, mean score and what the budget took."""
    pairs = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(c).alias("side")) for n, c in conditions.items()])
    long = df.select("fold", "segment", "label", "score", top, F.explode(pairs).alias("_p")).select("*", "_p.*")
    yes, hit = F.col(top), F.col("label") == 1
    return long.groupBy("fold", "segment", "condition", "side").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("label1"), F.avg("score").alias("mean_score"),
        count_if(yes).alias("top10_count"), count_if(yes & hit).alias("top10_true_positive"),
        count_if(yes & ~hit).alias("top10_false_positive"), count_if(~yes & hit).alias("top10_false_negative"),
    )


def selection_slices(
    df: DataFrame, conditions: Sequence[str], dims: Sequence[str] = ("model", "seed"), group: str = "group_id"
) -> DataFrame:
    """What a budget selection caught and missed for each value of each condition column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("condition"), F.col(c).cast("string").alias("value")) for c in conditions
    ])
    keys = [*dims, "segment", "condition", "value"]
    long = df.select(*dims, "segment", "label", "selected", group, F.explode(pairs).alias("_c")).select("*", "_c.*")
    yes, y = F.col("selected"), F.col("label")
    per_group = long.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("r"), F.sum(y).alias("p"), count_if(yes).alias("s"),
        count_if(yes & (y == 1)).alias("f"),
    )
    return per_group.groupBy(*keys).agg(
        F.sum("r").alias("rows"), F.count(F.lit(1)).alias("groups"), F.sum("p").alias("positives"),
        F.sum("s").alias("selected"), F.sum("f").alias("found"),
    ).withColumns({
        "missed": F.col("positives") - F.col("found"),
        "selected_negative": F.col("selected") - F.col("found"),
    })


def allocation(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Where a pooled selection landed: per fold (-1 = pooled) and segment, with score quantiles."""
    folds = df.withColumn("fold", F.explode(F.array(F.lit(-1), F.col("fold").cast("int"))))
    yes, y = F.col("selected"), F.col("label")
    return folds.groupBy(*dims, "fold", "segment").agg(
        F.count(F.lit(1)).alias("rows"), count_if(yes).alias("selected"),
        count_if(yes & (y == 1)).alias("found"), count_if(~yes & (y == 1)).alias("missed"),
    )


def seed_spread(table: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest of each metric over seeds."""
    out = []
    for m in metrics:
        out += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    return table.groupBy(*keys).agg(*out)


def seed_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ensemble score per row: the mean over seeds."""
    return df.groupBy(*keys).agg(F.avg("score").alias("score"))


def curve_points(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Precision-recall and cumulative-gain points, one per distinct score."""
    n, pos = F.col("n_before") + F.col("n"), F.col("pos_before") + F.col("pos")
    return cumulative(df, scope).select(
        *scope, "score", n.alias("inspected"), pos.alias("caught"),
        ratio(pos, n).alias("precision"), ratio(pos, F.col("pos_total")).alias("recall"),
        ratio(n, F.col("n_total")).alias("inspected_share"),
    )


def best_thresholds(df: DataFrame, scope: Sequence[str], required_recall: float = 1.0) -> DataFrame:
    """Threshold of the best F1 (then recall, precision, threshold) and the most precise one with enough recall."""
    points = curve_points(df, scope).where(F.col("recall").isNotNull())
    p, r = F.col("precision"), F.col("recall")
    f1 = ratio_or_zero(2 * p * r, p + r)
    enough = r >= required_recall - 1e-12
    chosen = points.withColumn("f1", f1).groupBy(*scope).agg(
        F.max(F.struct("f1", "recall", "precision", "score")).alias("a"),
        F.max(F.when(enough, F.struct("precision", "score"))).alias("b"),
    )
    return chosen.select(
        *scope, F.col("a.score").alias("f1_threshold"), F.col("a.f1").alias("inner_f1"),
        F.col("a.recall").alias("f1_recall"), F.col("b.score").alias("high_recall_threshold"),
        F.col("b.precision").alias("high_recall_precision"),
    )


def best_f2_threshold(df: DataFrame, scope: Sequence[str], points: int = 201) -> DataFrame:
    """Best F2 over evenly spaced score quantiles; the lowest threshold wins ties.

    What a threshold catches is a range sum over the score axis. Thresholds enter the score
    table as rows without weight, so one running sum answers all of them.
    """
    scope = list(scope)
    trial = quantiles(df, scope, "score", [i / (points - 1) for i in range(points)])
    rows = df.select(*scope, "score", F.lit(1).alias("w"), F.col("label").alias("y"), F.lit(False).alias("t"))
    marks = trial.select(
        *scope, F.col("quantile").alias("score"), F.lit(0).alias("w"), F.lit(0).alias("y"), F.lit(True).alias("t")
    )
    sums = {"n": F.col("w"), "pos": F.col("y"), "marks": F.col("t").cast("int")}
    table = running_by_value(rows.unionByName(marks), scope, "score", sums).where(F.col("marks") > 0)
    k, tp = F.col("n_before") + F.col("n"), F.col("pos_before") + F.col("pos")
    scored = table.withColumn("f2", ratio_or_zero(5 * tp, 4 * F.col("pos_total") + k)).withColumn("_k", k)
    best = scored.groupBy(*scope).agg(
        F.max(F.struct(F.round("f2", 12).alias("a"), (-F.col("score")).alias("b"), "f2", "score", "_k")).alias("m")
    )
    return best.select(
        *scope, F.col("m.score").alias("f2_threshold"), F.col("m.f2").alias("f2"), F.col("m._k").alias("inspected")
    )


def value_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def class_metrics(df: DataFrame, scope: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 of predicted classes, from the class-pair counts."""
    pairs = df.groupBy(*scope, truth, guess).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(*scope, "n", F.col(truth) == F.col(guess), F.explode(F.array(
        F.struct(F.lit("truth").alias("side"), F.col(truth).cast("string").alias("class")),
        F.struct(F.lit("guess").alias("side"), F.col(guess).cast("string").alias("class")),
    )).alias("s")).toDF(*scope, "n", "hit", "s").select(*scope, "n", "hit", "s.*")
    zero = F.lit(0)
    per_class = sides.groupBy(*scope, "class").agg(
        F.sum(F.when(F.col("side") == "truth", F.col("n")).otherwise(zero)).alias("t"),
        F.sum(F.when(F.col("side") == "guess", F.col("n")).otherwise(zero)).alias("g"),
        F.sum(F.when((F.col("side") == "truth") & F.col("hit"), F.col("n")).otherwise(zero)).alias("ok"),
    )
    return per_class.groupBy(*scope).agg(
        ratio(F.sum("ok"), F.sum("t")).alias("accuracy"),
        F.avg(ratio(F.col("ok"), F.col("t"))).alias("balanced_accuracy"),
        F.avg(ratio_or_zero(2 * F.col("ok"), F.col("t") + F.col("g"))).alias("f1_macro"),
    )


def class_log_loss(df: DataFrame, scope: Sequence[str], truth: str, classes: Sequence, probabilities: str = "probabilities") -> DataFrame:
    """Mean log-loss over any number of classes; ``probabilities`` is in the order of ``classes``.

    A row whose class is not among them is an error, as its loss is not defined.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(truth))
    unknown = F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(truth).cast("string"), F.lit("null")))).cast("double")
    p = F.when(place > 0, F.get(F.col(probabilities), (place - 1).cast("int"))).otherwise(unknown)
    safe = F.greatest(F.lit(PROBABILITY_CLIP), F.least(F.lit(1.0 - PROBABILITY_CLIP), p))
    return df.groupBy(*scope).agg(F.avg(-F.log(safe)).alias("log_loss"))


def regression_metrics(df: DataFrame, scope: Sequence[str], truth: str, guess: str) -> DataFrame:
    t, e = F.col(truth), F.col(truth) - F.col(guess)
    sums = df.groupBy(*scope).agg(
        F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(t).alias("_var"),
    )
    return sums.select(
        *scope, F.sqrt("_mse").alias("rmse"), "mae", (1.0 - ratio(F.col("_mse"), F.col("_var"))).alias("r2")
    )
