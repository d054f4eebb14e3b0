"""Candidate models as distributed Spark ML fits, out-of-fold scoring, calibration and nested selection.

A candidate is a function ``fit(training, features, seed)`` that returns a function adding
``score`` to a DataFrame. Fits loop on the driver, each one a distributed job; a small
thread pool lets several run at once. Nothing but model parameters reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linetriage.functions.columns import add_up, sigmoid
from linetriage.functions.sizing import small_table
from linetriage.operators import batched, budget, choose, quality
from linetriage.operators.derive import checked_sigmoid
from linetriage.operators.joins import candidate_pairs
from linetriage.operators.windows import average_rank
from linetriage.session import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]
Candidate = Callable[[DataFrame, Sequence[str], int], Scorer]

TOLERANCE = 1e-7  # relative change of the loss at which a logistic fit ends
ITERATIONS = 2000


@dataclass(frozen=True)
class Stored:
    """What a scorer needs to be built again: plain parameters and, for trees and kernels, a Spark model."""

    kind: str
    parameters: dict
    model: PipelineModel | None = None


def restored(stored: Stored, features: Sequence[str]) -> Scorer:
    """The scorer of stored parameters, with them as its attribute ``stored``."""
    if stored.kind == "linear":
        found = margin([tuple(r) for r in stored.parameters["rows"]])

        def score(rows: DataFrame) -> DataFrame:
            return rows.withColumn("_z", found).withColumn("score", checked_sigmoid(F.col("_z"))).drop("_z")

    elif stored.kind == "constant":

        def score(rows: DataFrame) -> DataFrame:
            return rows.withColumn("score", F.lit(float(stored.parameters["rate"])))

    elif stored.kind == "pipeline":

        def score(rows: DataFrame) -> DataFrame:
            out = stored.model.transform(rows).withColumn("score", vector_to_array("probability")[1])
            return out.drop("x", "rawPrediction", "probability", "prediction")

    else:

        def score(rows: DataFrame) -> DataFrame:
            out = stored.model.transform(_fourier(rows, features, stored.parameters))
            return out.withColumn("score", sigmoid(vector_to_array("rawPrediction")[1])).drop("x", "rawPrediction", "prediction")

    score.stored = stored
    return score


# -- linear models as a weights table -------------------------------------------------------


def class_facts(df: DataFrame, features: Sequence[str]) -> dict:
    """Row counts and population moments of the training rows, in one pass over one vector column."""
    vector = array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("x")
    stats = Summarizer.metrics("mean", "variance").summary(F.col("x")).alias("s")
    row = df.select("label", vector).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"), stats).first()
    n, p = row["n"], row["p"]
    if not p or p == n:
        raise ValueError("training rows need both classes")
    means, scales = row["s"]["mean"].toArray(), np.sqrt(row["s"]["variance"].toArray() * (n - 1) / n)
    return {"n": n, "p": p, **{f"m_{f}": float(m) for f, m in zip(features, means)},
            **{f"s_{f}": float(v) for f, v in zip(features, scales)}}


def class_weight(facts: Mapping, mode: str | None) -> Column:
    """Weight of a row by its class: balanced, sqrt (positives by the root of the class ratio) or none."""
    n, p = facts["n"], facts["p"]
    if mode == "balanced":
        return F.when(F.col("label") == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    if mode == "sqrt":
        return F.when(F.col("label") == 1, math.sqrt((n - p) / p)).otherwise(1.0)
    return F.lit(1.0)


def fit_logistic(
    df: DataFrame, features: Sequence[str], c: float = 0.1, weights: str | None = "balanced",
    row_weight: str | None = None, standardise: bool = True,
) -> list[tuple]:
    """L2 logistic regression on population-standardised features.

    Minimises 0.5 |w|^2 + c * sum(weight * loss); Spark divides the loss by the weight sum, hence regParam.
    Returns rows (feature, mean, scale, coef) and the intercept as the row without a feature.
    """
    facts = class_facts(df, features)
    weight = class_weight(facts, weights) * (F.col(row_weight) if row_weight else F.lit(1.0))
    means = [float(facts[f"m_{f}"]) if standardise else 0.0 for f in features]
    scales = [float(facts[f"s_{f}"]) or 1.0 if standardise else 1.0 for f in features]
    scaled = [(F.col(f) - m) / s for f, m, s in zip(features, means, scales)]
    ready = df.select(array_to_vector(F.array(*scaled)).alias("x"), F.col("label").cast("double"), weight.alias("w"))
    total = float(facts["n"]) if weights != "sqrt" and not row_weight else ready.agg(F.sum("w")).first()[0]
    model = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="w", regParam=1.0 / (c * total), elasticNetParam=0.0,
        standardization=False, tol=TOLERANCE, maxIter=ITERATIONS,
    ).fit(ready)
    losses = model.summary.objectiveHistory
    if len(losses) > ITERATIONS or len(losses) > 1 and losses[-2] - losses[-1] > 1e-6 * abs(losses[-1]):
        raise RuntimeError(f"the logistic fit has not converged in {len(losses) - 1} steps")
    rows = [(f, m, s, float(w)) for f, m, s, w in zip(features, means, scales, model.coefficients)]
    return [*rows, (None, None, None, float(model.intercept))]


def weights_table(spark: SparkSession, fits: Mapping[str, Sequence[tuple]]) -> DataFrame:
    """Weights of one or more segments in the form ``derive.linear_score`` reads."""
    rows = [(segment, *row) for segment, fit in fits.items() for row in fit]
    return spark.createDataFrame(rows, "segment string, feature string, mean double, scale double, coef double")


def strongest_weights(weights: DataFrame, top: int = 10) -> DataFrame:
    return weights.where(F.col("feature").isNotNull()).orderBy(F.abs("coef").desc(), "segment", "feature").limit(top)


@dataclass(frozen=True)
class Linear:
    """What a logistic candidate is, for fits of many at once; without ``segments`` all rows are fitted together."""

    c: float
    weights: str | None
    segments: tuple[str, ...] | None = None


def margin(fit: Sequence[tuple]) -> Column:
    """Margin of one fit as a column expression over the feature columns."""
    *parts, (_, _, _, intercept) = fit
    return add_up([F.lit(intercept), *[(F.col(f) - m) / s * w for f, m, s, w in parts]])


def logistic(c: float = 0.1, weights: str | None = "balanced", row_weight: str | None = None) -> Candidate:

    def fit(df: DataFrame, features: Sequence[str], seed: int) -> Scorer:
        return restored(Stored("linear", {"rows": fit_logistic(df, features, c, weights, row_weight)}), features)

    fit.linear = None if row_weight else Linear(c, weights)
    return fit


def prior() -> Candidate:
    """Training prevalence for every row."""

    def fit(df: DataFrame, features: Sequence[str], seed: int) -> Scorer:
        return restored(Stored("constant", {"rate": df.agg(F.avg("label")).first()[0]}), features)

    return fit


# -- trees and kernels ------------------------------------------------------------------------


def _vector_fit(estimator, df: DataFrame, features: Sequence[str], weight: Column) -> PipelineModel:
    ready = df.select(*features, F.col("label").cast("double").alias("label"), weight.alias("w"))
    assemble = VectorAssembler(inputCols=list(features), outputCol="x")
    return Pipeline(stages=[assemble, estimator]).fit(ready)


def forest(trees: int = 300, depth: int = 6, least: int = 4, weights: str | None = "balanced") -> Candidate:
    def fit(df: DataFrame, features: Sequence[str], seed: int) -> Scorer:
        weight = class_weight(class_facts(df, features[:1]), weights)
        estimator = RandomForestClassifier(
            featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth,
            minInstancesPerNode=least, featureSubsetStrategy="sqrt", seed=seed,
        )
        return restored(Stored("pipeline", {}, _vector_fit(estimator, df, features, weight)), features)

    return fit


def boosted(
    depth: int = 3, rounds: int = 200, step: float = 0.03, subsample: float = 0.85, columns: str = "0.85",
    weights: str | None = "balanced", bins: int = 64,
) -> Candidate:
    """Gradient-boosted trees; regularised by depth, step, row and column sampling (Spark has no L2 leaf term)."""

    def fit(df: DataFrame, features: Sequence[str], seed: int) -> Scorer:
        weight = class_weight(class_facts(df, features[:1]), weights)
        estimator = GBTClassifier(
            featuresCol="x", labelCol="label", weightCol="w", maxDepth=depth, maxIter=rounds, stepSize=step,
            subsamplingRate=subsample, featureSubsetStrategy=columns, maxBins=bins, seed=seed,
        )
        return restored(Stored("pipeline", {}, _vector_fit(estimator, df, features, weight)), features)

    return fit


def _fourier(rows: DataFrame, features: Sequence[str], parameters: Mapping) -> DataFrame:
    """Random Fourier features of the standardised columns, as the vector x; drawn from the stored seed."""
    means, scales = np.array(parameters["means"], dtype=float), np.array(parameters["scales"], dtype=float)
    size, source = parameters["size"], np.random.default_rng(parameters["seed"])
    frequencies = source.normal(scale=math.sqrt(2 * parameters["gamma"]), size=(len(means), size))
    phases = source.uniform(0, 2 * math.pi, size=size)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        scaled = (np.vstack(x.to_numpy()) - means) / scales
        return pd.Series(list(math.sqrt(2.0 / size) * np.cos(scaled @ frequencies + phases)))

    values = F.array(*[F.col(f).cast("double") for f in features])
    return rows.withColumn("x", array_to_vector(project(values)))


def fourier_svc(c: float = 1.0, size: int = 256) -> Candidate:
    """RBF-kernel classifier: random Fourier features and a linear SVM; score is the logistic of the margin."""

    def fit(df: DataFrame, features: Sequence[str], seed: int) -> Scorer:
        facts = class_facts(df, features)
        varying = sum(1 for f in features if facts[f"s_{f}"])
        parameters = {
            "means": [float(facts[f"m_{f}"]) for f in features], "scales": [float(facts[f"s_{f}"]) or 1.0 for f in features],
            "gamma": 1.0 / max(varying, 1),  # 1 / (features * variance); scaled features have variance 1
            "size": size, "seed": seed,
        }
        ready = _fourier(df.select(*features, "label"), features, parameters).select(
            "x", F.col("label").cast("double").alias("label"), class_weight(facts, "balanced").alias("w")
        )
        machine = LinearSVC(featuresCol="x", labelCol="label", weightCol="w", regParam=1.0 / (c * facts["n"]), maxIter=100)
        return restored(Stored("kernel", parameters, Pipeline(stages=[machine]).fit(ready)), features)

    return fit


def per_segment(candidate: Candidate, segments: Sequence[str]) -> Candidate:
    """An independent fit for each segment."""

    def fit(df: DataFrame, features: Sequence[str], seed: int) -> Scorer:
        scorers = {s: candidate(df.where(F.col("segment") == s), features, seed) for s in segments}

        def score(rows: DataFrame) -> DataFrame:
            parts = [scorers[s](rows.where(F.col("segment") == s)) for s in segments]
            return reduce(DataFrame.unionByName, parts)

        return score

    linear = getattr(candidate, "linear", None)
    fit.linear = linear and replace(linear, segments=tuple(segments))
    return fit


def _as_they_are() -> dict[str, batched.View]:
    return {"rows": batched.View(F.lit(1), F.col("label"))}


def fit_segments(df: DataFrame, features: Sequence[str], chosen: Mapping[str, Candidate], seed: int) -> dict[str, Scorer]:
    """The fit of each segment's candidate on all its rows; logistic ones are fitted together."""
    linear = {s: c.linear for s, c in chosen.items() if getattr(c, "linear", None)}
    scorers = {s: c(df.where(F.col("segment") == s), features, seed) for s, c in chosen.items() if s not in linear}
    if linear:
        jobs = [batched.Job((s,), "rows", m.c, m.weights, segment=s) for s, m in linear.items()]
        placed = df if "fold" in df.columns else df.withColumn("fold", F.lit(0))
        for (s,), f in batched.fit_all(placed, features, _as_they_are(), jobs).items():
            parts = zip(features, f.mean.tolist(), f.scale.tolist(), f.coef.tolist())
            scorers[s] = restored(Stored("linear", {"rows": [*parts, (None, None, None, f.intercept)]}), features)
    return {s: scorers[s] for s in chosen}


# -- out-of-fold scoring ------------------------------------------------------------------------


def oof_scores(
    df: DataFrame, features: Sequence[str], candidates: Mapping[str, Candidate], folds: Sequence[int], seed: int,
    fold: str = "fold", keep: Sequence[str] = (), threads: int = 4,
) -> DataFrame:
    """Fit on fold != k and score fold = k for every candidate; long table, each row once per candidate.

    Logistic candidates are fitted together, for all folds and segments in one pass per step; others one by one.
    The training frame should be materialised (cached or checkpointed) by the caller. A group that lies
    in several folds, or a row whose fold is not among ``folds``, is an error.
    """
    check_folds(df, fold, folds)
    identity = [c for c in ("segment", "row_id", "group_id", "label", fold, *keep) if c in df.columns]

    def one(task: tuple[str, int]) -> DataFrame:
        name, k = task
        score = candidates[name](df.where(F.col(fold) != k), features, seed)
        out = score(df.where(F.col(fold) == k))
        return out.select(*identity, F.lit(name).alias("candidate"), F.lit(seed).alias("seed"), "score")

    linear = {name: c.linear for name, c in candidates.items() if getattr(c, "linear", None)}
    tasks = [(name, k) for name in candidates if name not in linear for k in folds]
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, tasks))
    parts += [
        z.select(*identity, "candidate", F.lit(seed).alias("seed"), checked_sigmoid(F.col("z")).alias("score"))
        for z in _linear_margins(df, features, linear, folds, fold)]
    return reduce(DataFrame.unionByName, parts)


def _linear_margins(
    df: DataFrame, features: Sequence[str], linear: Mapping[str, Linear], folds: Sequence[int], fold: str
) -> list[DataFrame]:
    """The rows of ``df`` with (candidate, z) of each logistic candidate's fits on the other folds."""
    jobs = [
        batched.Job((name, int(k), *([s] if m.segments else [])), "rows", m.c, m.weights, fold=int(k), segment=s)
        for name, m in linear.items() for k in folds for s in m.segments or [None]]
    if not jobs:
        return []
    placed = df if "segment" in df.columns else df.withColumn("segment", F.lit("all"))
    if fold != "fold":
        placed = placed.withColumn("fold", F.col(fold))
    fits = batched.fit_all(placed, features, _as_they_are(), jobs)
    out = []
    for on in (("fold",), ("fold", "segment")):
        some = {key: f for key, f in fits.items() if len(key) == 1 + len(on)}
        if some:
            out.append(batched.margins(placed, features, some, ("candidate", *on), on))
    return out


def check_folds(df: DataFrame, fold: str, folds: Sequence[int]) -> None:
    outside = F.count(F.when(~F.coalesce(F.col(fold).isin(list(folds)), F.lit(False)), 1))
    if "group_id" in df.columns:
        per = df.groupBy("group_id").agg(outside.alias("o"), (F.min(fold) < F.max(fold)).alias("s"))
        found = per.agg(F.sum("o").alias("outside"), F.count(F.when(F.col("s"), 1)).alias("shared")).first()
    else:
        found = df.agg(outside.alias("outside"), F.lit(0).alias("shared")).first()
    if found["outside"] or found["shared"]:
        raise ValueError(f"{found['outside']} rows without a known fold, {found['shared']} groups in several folds")


def prior_oof(df: DataFrame) -> DataFrame:
    """Prior baseline out of fold, without a fit per fold: totals minus the row's own fold."""
    per = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    total = per.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    rest = per.select("fold", ((F.lit(total["p"]) - F.col("p")) / (F.lit(total["n"]) - F.col("n"))).alias("score"))
    return df.drop("score").join(small_table(rest), "fold")


# -- calibration --------------------------------------------------------------------------------


def fit_sigmoid(df: DataFrame, score: str = "score") -> tuple[float, float]:
    """Sigmoid map with smoothed targets (n+ + 1) / (n+ + 2) and 1 / (n- + 2): two weighted rows per input."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    p, q = facts["p"], facts["n"] - facts["p"]
    target = F.when(F.col("label") == 1, (p + 1.0) / (p + 2.0)).otherwise(1.0 / (q + 2.0))
    sides = F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - target).alias("w"))
    )
    rows = df.select(array_to_vector(F.array(F.col(score))).alias("x"), F.explode(sides).alias("s")).select("x", "s.*")
    model = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, standardization=True, tol=1e-12, maxIter=500
    ).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def fit_scalar_map(df: DataFrame, c: float = 10.0) -> tuple[float, float]:
    """One-feature logistic map of a score, without class weights or scaling."""
    fit = fit_logistic(df, ["score"], c, None, standardise=False)
    return fit[0][3], fit[1][3]


def apply_map(score: Column, slope: float, intercept: float) -> Column:
    return sigmoid(score * slope + intercept)


def calibrated_oof(
    df: DataFrame, features: Sequence[str], inner: DataFrame, folds: Sequence[int], c: float = 0.1
) -> DataFrame:
    """Raw and sigmoid-calibrated logistic score out of fold, with the map of each outer fold.

    ``inner`` has (outer, group_id, inner_fold). The map of an outer fold is fitted on the inner
    out-of-fold margins of its training rows only. The fits of all inner folds of an outer fold are made
    together, as are those of all outer folds and all maps.
    """
    view = _as_they_are()
    parts = []
    for k in folds:
        placed = cut_lineage(df.where(F.col("fold") != k).drop("fold").join(
            inner.where(F.col("outer") == k).select("group_id", F.col("inner_fold").alias("fold")), "group_id"))
        count = placed.agg(F.max("fold")).first()[0] + 1
        jobs = [batched.Job((i,), "rows", c, fold=i) for i in range(count)]
        fits = batched.fit_all(placed, features, view, jobs)
        z = batched.margins(placed, features, fits, ("fold",), ("fold",))
        parts.append(z.select(F.lit(k).alias("outer"), "label", F.col("z").alias("score")))
    maps = small_table(batched.sigmoid_maps(reduce(DataFrame.unionByName, parts), ["outer"]).withColumnRenamed("outer", "fold"))
    fits = batched.fit_all(df, features, view, [batched.Job((int(k),), "rows", c, fold=int(k)) for k in folds])
    scored = batched.margins(df, features, fits, ("fold",), ("fold",)).join(maps, "fold")
    return scored.select(
        "segment", "row_id", "group_id", "label", "fold", "z", "slope", "intercept", "steepest",
        sigmoid(F.col("z")).alias("raw"), sigmoid(F.col("z") * F.col("slope") + F.col("intercept")).alias("sigmoid"))


def calibrated_pair(scores: DataFrame, pair: Sequence[str], c: float = 10.0) -> DataFrame:
    """Two candidates as one calibrated, decided score per row.

    ``scores`` (segment, row_id, group_id, label, fold, candidate, score) holds both candidates for every row.
    Their shares of rank within (segment, fold) are averaged; a logistic map and the threshold of the best F1
    come from the other folds of the segment. Adds blend, slope, intercept, steepest, score, threshold, decision.
    """
    keys = ["segment", "row_id", "group_id", "fold", "label"]
    wide = cut_lineage(candidate_pairs(scores, keys, list(pair)))
    for name in pair:
        wide = average_rank(wide, ["segment", "fold"], f"score_{name}", f"share_{name}")
    ranked = cut_lineage(wide.select(*keys, ((F.col(f"share_{pair[0]}") + F.col(f"share_{pair[1]}")) / 2).alias("blend")))
    maps = small_table(batched.sigmoid_maps(ranked, ["segment"], "blend", c, smooth=False, fold="fold"))
    mapped = sigmoid(F.col("blend") * F.col("slope") + F.col("intercept"))
    held = ranked.join(maps, ["segment", "fold"]).withColumn("score", mapped)
    folds = [r[0] for r in ranked.select("fold").distinct().collect()]
    others = F.filter(F.array(*[F.lit(k) for k in folds]), lambda k: k != F.col("fold"))
    training = ranked.withColumn("k", F.explode(others)).drop("fold").withColumnRenamed("k", "fold")
    limits = quality.best_thresholds(training.join(maps, ["segment", "fold"]).withColumn("score", mapped), ["segment", "fold"])
    limits = small_table(limits.select("segment", "fold", F.col("f1_threshold").alias("threshold")))
    return held.join(limits, ["segment", "fold"]).withColumn("decision", F.col("score") >= F.col("threshold"))


# -- nested selection ---------------------------------------------------------------------------


def inner_metrics(inner_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Found at the 10% budget, AP, AUC and thresholds of each candidate on inner out-of-fold rows."""
    keys = [*keys, "candidate"]
    chosen = budget.select(inner_scores, 0.1, budget.GLOBAL, dims=keys)
    found = chosen.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("label"))), F.lit(0)).alias("found")
    )
    ranked = quality.ranking_quality(inner_scores, keys)
    return found.join(ranked, keys).join(quality.best_thresholds(inner_scores, keys), keys)


@dataclass(frozen=True)
class NestedRun:
    """All tables of a nested selection; ``runs`` stores and verifies them."""

    inner_scores: DataFrame
    outer_scores: DataFrame
    metrics: DataFrame
    choices: DataFrame
    decided: DataFrame
    ledger: DataFrame | None = None


def nested_selection(
    df: DataFrame, features: Sequence[str], candidates: Mapping[str, Candidate], inner: DataFrame,
    outer: Sequence[int], reference: str, seed: int, threads: int = 4,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chosen scores with decisions, the choices, and the inner metrics of ``nested_run``."""
    run = nested_run(df, features, candidates, inner, outer, reference, seed, threads)
    return run.decided, run.choices, run.metrics


def nested_run(
    df: DataFrame, features: Sequence[str], candidates: Mapping[str, Candidate], inner: DataFrame,
    outer: Sequence[int], reference: str, seed: int, threads: int = 4,
) -> NestedRun:
    """Choose a candidate per (outer fold, segment, route) on inner folds and score the outer fold with it.

    The route ``union`` has no winner: it decides by the best margin over the high-recall thresholds of all candidates.
    """
    tables = {}
    for k in outer:
        training = df.where(F.col("fold") != k).join(
            inner.where(F.col("outer") == k).select("group_id", "inner_fold"), "group_id"
        ).persist()
        count = training.agg(F.max("inner_fold")).first()[0] + 1
        part = oof_scores(training, features, candidates, range(count), seed, "inner_fold", threads=threads)
        tables[k] = cut_lineage(part.withColumn("outer", F.lit(k)))
        training.unpersist()
    outer_scores = cut_lineage(
        oof_scores(df, features, candidates, outer, seed, threads=threads).withColumn("outer", F.col("fold"))
    )
    return routed_run(reduce(DataFrame.unionByName, tables.values()), outer_scores, list(candidates), reference)


def routed_run(
    inner_scores: DataFrame, outer_scores: DataFrame, candidates: Sequence[str], reference: str, ledger: DataFrame | None = None
) -> NestedRun:
    """Metrics, choices and decisions from the scores of all candidates on inner and outer folds."""
    metrics = cut_lineage(inner_metrics(inner_scores, ["outer", "segment"]))
    chosen = choose.routes(metrics, ["outer", "segment"], reference, candidates)
    routed = choose.apply_routes(outer_scores, chosen, ["outer", "segment"])
    limits = metrics.select("outer", "segment", "candidate", "f1_threshold", "high_recall_threshold")
    decided = routed.join(limits, ["outer", "segment", "candidate"]).withColumns({
        "f1_decision": F.col("score") >= F.col("f1_threshold"),
        "high_recall_decision": F.col("score") >= F.col("high_recall_threshold"),
    }).drop("f1_threshold", "high_recall_threshold")
    united = union_route(outer_scores, limits.drop("f1_threshold"), ["outer", "segment"]).select(
        "outer", "segment", "row_id", "label", "score", F.lit("union").alias("route"), F.lit("union").alias("candidate"),
        F.col("decision").alias("f1_decision"), F.col("decision").alias("high_recall_decision"))
    decided = decided.unionByName(united, allowMissingColumns=True)
    return NestedRun(inner_scores, outer_scores, metrics, chosen, decided, ledger)


def union_route(outer_scores: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best margin over all candidates' high-recall thresholds, as a score and a decision."""
    joined = outer_scores.join(thresholds, [*keys, "candidate"])
    margin = F.max(F.col("score") - F.col("high_recall_threshold"))
    rows = joined.groupBy(*keys, "row_id", "label").agg(margin.alias("_m"))
    return rows.select(
        *keys, "row_id", "label", ((F.col("_m") + 1.0) / 2.0).alias("score"), (F.col("_m") >= 0).alias("decision")
    )
