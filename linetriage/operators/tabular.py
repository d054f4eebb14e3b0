"""Generic tabular baseline: median or mode for missing values, scaled numbers, categories, ridge or logistic fit.

The fitted model is a small table of weights. Categories are a counted table that is joined, never an array in the
plan; a ridge fit is one aggregation of sums (per combination of categories before any shuffle) and a solve.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linetriage.functions.columns import hash_text
from linetriage.functions.sizing import small_table
from linetriage.operators.ordering import rank_by_hash
from linetriage.operators.quantiles import quantiles

SOLVED = 1024  # widest ridge that is solved from its sums; wider ones are found by descent, with the same weights
TOLERANCE = 1e-10
ITERATIONS = 1000
WEIGHTS = "term string, value string, coef array<double>"


def _clean(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(F.abs(value) == float("inf"), F.raise_error(F.lit(f"infinite value in {name}")).cast("double")).when(
        ~F.isnan(value), value)


@dataclass
class Tabular:
    """A fitted baseline. ``weights``: one row per (text column, category), a coefficient for each class."""

    numeric: list[str]
    text: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    scales: dict[str, float] = field(default_factory=dict)
    slopes: dict[str, list[float]] = field(default_factory=dict)
    intercepts: list[float] = field(default_factory=list)
    weights: DataFrame | None = None
    classes: list | None = None

    def number(self, name: str) -> Column:
        return F.coalesce(_clean(name), F.lit(self.medians[name]))

    def word(self, name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(self.modes[name]))

    def margins(self, rows: DataFrame, out: str) -> DataFrame:
        """``rows`` with one margin per class (or the predicted value) in the array ``out``; new categories weigh nothing."""
        width = len(self.intercepts)
        parts = [[F.lit(b)] for b in self.intercepts]
        for c in self.numeric:
            for at in range(width):
                parts[at].append(self.number(c) / F.lit(self.scales[c]) * F.lit(self.slopes[c][at]))
        ready = rows.withColumn(out, F.array(*[reduce(lambda a, b: a + b, p) for p in parts]))
        for c in self.text:
            table = self.weights.where(F.col("term") == c).select(F.col("value").alias("_category"), F.col("coef").alias("_weight"))
            ready = ready.withColumn("_key", self.word(c)).join(small_table(table), F.col("_key") == F.col("_category"), "left")
            nothing = F.array(*[F.lit(0.0)] * width)
            ready = ready.withColumn(out, F.zip_with(out, F.coalesce("_weight", nothing), lambda a, b: a + b)).drop(
                "_key", "_category", "_weight")
        return ready

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds prediction; for classes also probabilities (in the order of ``classes``) and, for two, score."""
        ready = self.margins(rows, "_margins")
        if self.classes is None:
            return ready.withColumn("prediction", F.col("_margins")[0]).drop("_margins")
        top = F.array_max("_margins")
        raised = F.transform("_margins", lambda m: F.exp(m - top))
        total = F.aggregate(raised, F.lit(0.0), lambda a, b: a + b)
        named = F.array(*[F.lit(v) for v in self.classes])
        out = ready.withColumn("prediction", F.element_at(named, F.array_position("_margins", top).cast("int"))).withColumn(
            "probabilities", F.transform(raised, lambda v: v / total)).drop("_margins")
        return out.withColumn("score", F.col("probabilities")[1]) if len(self.classes) == 2 else out


def prepare(training: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> tuple[Tabular, DataFrame | None]:
    """What fills missing values, and the counted categories (term, value, n, place) of the filled text columns.

    Medians are exact, from value counts; NaN is missing. Of equally frequent categories the smallest fills.
    A column without any value is an error.
    """
    medians: dict[str, float] = {}
    if numeric:
        # Missing values leave before the rows are made: the order's own null check could run ahead of a filter on them.
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _clean(c).alias("x")) for c in numeric])
        long = training.select(F.explode(F.filter(pairs, lambda p: p["x"].isNotNull())).alias("p")).select("p.*")
        medians = {r["feature"]: r["quantile"] for r in quantiles(long, ["feature"], "x", [0.5]).collect()}
    modes: dict[str, str] = {}
    categories = None
    if text:
        pairs = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("string").alias("value")) for c in text])
        counted = training.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy(
            "term", "value").agg(F.count(F.lit(1)).alias("n"))
        first = counted.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m"))
        modes = {r["term"]: r["m"]["value"] for r in first.collect()}
        ranked = rank_by_hash(counted.withColumn("_text", hash_text(0, "term", "value")), ["term"], "_text", "value", "place")
        categories = ranked.select("term", "value", "n", (F.col("place") - 1).alias("place"))
    empty = sorted({*numeric, *text} - {*medians, *modes})
    if empty:
        raise ValueError(f"columns without any value: {empty}")
    return Tabular(list(numeric), list(text), medians, modes), categories


def _sums(model: Tabular, training: DataFrame, target: str) -> dict:
    """Sums of products of all terms, each other's and with the target; numbers are taken from their median."""
    numbers = [f"_n{i}" for i in range(len(model.numeric))]
    words = [f"_w{i}" for i in range(len(model.text))]
    ready = training.select(
        *[(model.number(c) - F.lit(model.medians[c])).alias(n) for c, n in zip(model.numeric, numbers)],
        *[model.word(c).alias(w) for c, w in zip(model.text, words)], F.col(target).cast("double").alias("_y"))
    products = {(a, b): F.sum(F.col(a) * F.col(b)) for i, a in enumerate(numbers) for b in [*numbers[i:], "_y"]}
    per = ready.groupBy(*words).agg(
        F.count(F.lit(1)).cast("double").alias("_rows"), F.sum("_y").alias("_sum_y"),
        *[F.sum(n).alias(f"_sum{n}") for n in numbers], *[v.alias(f"_p{a}{b}") for (a, b), v in products.items()])
    ones, ys = F.lit("1"), F.lit("y")
    none = F.lit(None).cast("string")
    named = dict(zip(numbers, model.numeric)) | dict(zip(words, model.text))
    entries = [(ones, none, ones, none, F.col("_rows")), (ones, none, ys, none, F.col("_sum_y"))]
    entries += [(ones, none, F.lit(f"#{named[n]}"), none, F.col(f"_sum{n}")) for n in numbers]
    entries += [(F.lit(f"#{named[a]}"), none, ys if b == "_y" else F.lit(f"#{named[b]}"), none, F.col(f"_p{a}{b}")) for a, b in products]
    for i, w in enumerate(words):
        me = (F.lit(named[w]), F.col(w))
        entries += [(*me, ones, none, F.col("_rows")), (*me, ys, none, F.col("_sum_y")), (*me, *me, F.col("_rows"))]
        entries += [(*me, F.lit(f"#{named[n]}"), none, F.col(f"_sum{n}")) for n in numbers]
        entries += [(*me, F.lit(named[v]), F.col(v), F.col("_rows")) for v in words[i + 1 :]]
    rows = F.array(*[F.struct(*[c.alias(n) for c, n in zip(e, ("a", "av", "b", "bv", "v"))]) for e in entries])
    table = per.select(F.explode(rows).alias("e")).select("e.*").groupBy("a", "av", "b", "bv").agg(F.sum("v").alias("v"))
    return {((r["a"], r["av"]), (r["b"], r["bv"])): r["v"] for r in table.collect()}


def _solve(model: Tabular, training: DataFrame, target: str, alpha: float) -> list[tuple]:
    sums = _sums(model, training, target)
    one, y = ("1", None), ("y", None)
    terms = [(f"#{c}", None) for c in model.numeric] + sorted(
        {a for a, _ in sums if a[0] in model.text}, key=lambda t: (model.text.index(t[0]), t[1]))
    n = sums[one, one]

    def total(a, b):
        return sums.get((a, b), sums.get((b, a), 0.0))

    means = np.array([total(t, one) / n for t in terms])
    y_mean = sums[one, y] / n
    gram = np.array([[total(a, b) for b in terms] for a in terms]).reshape(len(terms), len(terms)) - n * np.outer(means, means)
    slope = np.array([total(t, y) for t in terms]) - n * means * y_mean
    scales = np.array([np.sqrt(max(gram[i, i], 0.0) / n) or 1.0 if i < len(model.numeric) else 1.0 for i in range(len(terms))])
    coef = np.linalg.solve(gram / np.outer(scales, scales) + alpha * np.eye(len(terms)), slope / scales)
    shift = np.array([model.medians[t[0][1:]] if t[1] is None else 0.0 for t in terms])
    model.scales = {c: float(s) for c, s in zip(model.numeric, scales)}
    model.slopes = {c: [float(w)] for c, w in zip(model.numeric, coef)}
    model.intercepts = [float(y_mean - ((means + shift) / scales) @ coef)]
    return [(t[0], t[1], [float(w)]) for t, w in zip(terms, coef) if t[1] is not None]


def _vectors(model: Tabular, training: DataFrame, categories: DataFrame | None, label: Column) -> DataFrame:
    """Rows as (label, x): scaled numbers, then a place for every category of every text column."""
    ready = training.withColumn("_label", label)
    stats = ready.agg(F.lit(1), *[F.stddev_pop(model.number(c)).alias(c) for c in model.numeric]).first()
    model.scales = {c: stats[c] or 1.0 for c in model.numeric}
    places = []
    for i, c in enumerate(model.text):
        table = categories.where(F.col("term") == c).select(F.col("value").alias("_category"), F.col("place").cast("double").alias(f"_place{i}"))
        ready = ready.withColumn("_key", model.word(c)).join(small_table(table), F.col("_key") == F.col("_category")).drop("_key", "_category")
        places.append(f"_place{i}")
    parts, names = [], []
    if model.numeric:
        parts.append(array_to_vector(F.array(*[model.number(c) / F.lit(model.scales[c]) for c in model.numeric])).alias("_numbers"))
        names.append("_numbers")
    ready = ready.select("_label", *parts, *places)
    if places:
        spots = [f"_hot{i}" for i in range(len(places))]
        ready = OneHotEncoder(inputCols=places, outputCols=spots, dropLast=False).fit(ready).transform(ready)
        names += spots
    return VectorAssembler(inputCols=names, outputCol="x").transform(ready).select("_label", "x")


def _place_weights(model: Tabular, coef: np.ndarray, categories: DataFrame | None, spark: SparkSession) -> None:
    """Spread a coefficient matrix (class, place of ``_vectors``) over numbers and categories."""
    m = len(model.numeric)
    model.slopes = {c: [float(v) for v in coef[:, i]] for i, c in enumerate(model.numeric)}
    model.weights = spark.createDataFrame([], WEIGHTS)
    start = m
    for c in model.text:
        mine = categories.where(F.col("term") == c)
        width = mine.count()
        block = [(i, [float(v) for v in coef[:, start + i]]) for i in range(width)]
        table = spark.createDataFrame(block, "place long, coef array<double>")
        model.weights = model.weights.unionByName(mine.join(table, "place").select("term", "value", "coef"))
        start += width


def fit(
    training: DataFrame, numeric: Sequence[str], text: Sequence[str], target: str, regression: bool = False,
    alpha: float = 1.0, solved: int = SOLVED,
) -> Tabular:
    """Fit the baseline: ridge 0.5 |w|^2 alpha + squared error, or logistic 0.5 |w|^2 alpha + log-loss over all classes.

    Numbers are divided by their population deviation, categories are not scaled, the intercept is free. Rows must
    have a target. The categories' weights are the only part that grows with the data: one per category and class.
    """
    if not numeric and not text:
        raise ValueError("no input columns")
    spark = training.sparkSession
    facts = training.agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("known")).first()
    if not facts["n"] or facts["n"] != facts["known"]:
        raise ValueError(f"{facts['n'] - facts['known']} of {facts['n']} training rows have no target")
    model, categories = prepare(training, numeric, text)
    n = facts["n"]
    width = len(numeric) + (categories.count() if categories is not None else 0)
    if regression and width <= solved:
        model.weights = spark.createDataFrame(_solve(model, training, target, alpha), WEIGHTS)
        return model
    if regression:
        # Spark divides the penalty by the target's deviation, so the target is given with a deviation of one.
        unit = training.agg(F.stddev(F.col(target).cast("double"))).first()[0] or 1.0
        found = LinearRegression(
            featuresCol="x", labelCol="_label", regParam=alpha / n, elasticNetParam=0.0, standardization=False,
            solver="l-bfgs", tol=TOLERANCE, maxIter=ITERATIONS,
        ).fit(_vectors(model, training, categories, F.col(target).cast("double") / F.lit(unit)))
        model.intercepts = [float(found.intercept) * unit]
        _place_weights(model, found.coefficients.toArray()[None, :] * unit, categories, spark)
        return model
    classes = sorted(r[0] for r in training.select(target).distinct().collect())
    if len(classes) < 2:
        raise ValueError("training rows need at least two classes")
    label = (F.array_position(F.array(*[F.lit(v) for v in classes]), F.col(target)) - 1).cast("double")
    found = LogisticRegression(
        featuresCol="x", labelCol="_label", regParam=alpha / n, elasticNetParam=0.0, standardization=False,
        family="binomial" if len(classes) == 2 else "multinomial", tol=TOLERANCE, maxIter=ITERATIONS,
    ).fit(_vectors(model, training, categories, label))
    coef, free = found.coefficientMatrix.toArray(), found.interceptVector.toArray()
    if len(classes) == 2:
        coef, free = np.vstack([np.zeros_like(coef), coef]), np.concatenate([[0.0], free])
    model.classes, model.intercepts = classes, [float(v) for v in free]
    _place_weights(model, coef, categories, spark)
    return model


def strongest(model: Tabular, top: int = 10) -> DataFrame:
    """The ``top`` weights of greatest size of a one-margin model, as (term, value, coef)."""
    spark = model.weights.sparkSession
    numbers = spark.createDataFrame([(c, None, w) for c, w in model.slopes.items()], WEIGHTS)
    return numbers.unionByName(model.weights).select("term", "value", F.element_at("coef", -1).alias("coef")).orderBy(
        F.abs("coef").desc(), "term", "value").limit(top)
