"""Many logistic fits at once: every step is one pass over the rows for all fits together.

A fit is a choice of rows (all but one fold, one segment or all), a view of them (how often a row counts and
which label it has) and a penalty. Tasks sum gradients and curvatures of all fits over their rows; Spark adds
them up by fit, and the driver, which holds a few numbers per fit and feature, takes the Newton steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import sigmoid
from linetriage.functions.sizing import small_table

STEPS = 60
ENOUGH = 1e-10  # squared Newton step in the metric of the curvature, relative to the loss


@dataclass(frozen=True)
class View:
    """How rows enter a fit: ``times`` (0 leaves a row out), its label there, and a further weight."""

    times: Column
    label: Column
    weight: Column | None = None


@dataclass(frozen=True)
class Job:
    """One fit: rows of ``segment`` (None: all) outside of ``fold`` (None: all), seen through ``view``."""

    key: tuple
    view: str
    c: float = 0.1
    weights: str | None = "balanced"
    fold: int | None = None
    segment: str | None = None
    standardise: bool = True
    features: tuple[int, ...] | None = None  # positions among all features; None for all


@dataclass
class Found:
    """A fit's result. ``steepest`` is the largest slope of the loss left, relative to ``c`` times the weight."""

    features: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float
    rows: int
    positives: int
    steepest: float = field(default=math.nan)

    def raw(self, size: int) -> tuple[list[float], float]:
        """Weights and intercept on the features as they are."""
        w = np.zeros(size)
        w[list(self.features)] = self.coef / self.scale
        return w.tolist(), float(self.intercept - (self.mean * self.coef / self.scale).sum())


def _ready(rows: DataFrame, features: Sequence[str], views: Mapping[str, View]) -> DataFrame:
    """Rows as (segment, fold, x, per view: times, label, weight)."""
    columns = []
    for v in views.values():
        one = v.weight if v.weight is not None else F.lit(1.0)
        columns += [v.times.cast("double"), v.label.cast("double"), one.cast("double")]
    return rows.select(
        F.col("segment").cast("string").alias("segment"), F.col("fold").cast("int").alias("fold"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.array(*columns).alias("seen"))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def _summed(ready: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], add) -> dict[int, np.ndarray]:
    """Sums of vectors by number over all tasks: per task first, then per number."""
    schema = pa.schema([("id", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def out(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([v.tolist()], schema.field(1).type)], schema=schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out(partial(b for b in batches if b.num_rows))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy()
                sums[i] = add(sums[i], v) if i in sums else v
        yield from out(sums)

    ddl = "id long, sums array<double>"
    found = ready.mapInArrow(first, ddl).repartition("id").mapInArrow(second, ddl).collect()
    return {r["id"]: np.array(r["sums"]) for r in found}


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments (count, positives, means, sums of squares about them) of two disjoint sets of rows together."""
    size = (len(a) - 2) // 2
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[2 : 2 + size] - a[2 : 2 + size]
    mean = a[2 : 2 + size] + gap * (b[0] / n)
    squares = a[2 + size :] + b[2 + size :] + gap * gap * (a[0] * b[0] / n)
    return np.concatenate([[n, a[1] + b[1]], mean, squares])


def moments(ready: DataFrame, names: Sequence[str]) -> dict[tuple[str, str, int], np.ndarray]:
    """Moments per (view, segment, fold), to be merged for any fit: no pass per fit."""
    places = [(r["segment"], r["fold"]) for r in ready.select("segment", "fold").distinct().collect()]
    number = {p: i for i, p in enumerate(places)}

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, seen = _numbers(batch, "x"), _numbers(batch, "seen")
            at = np.array([number[p] for p in zip(batch.column("segment").to_pylist(), batch.column("fold").to_pylist())])
            for place in np.unique(at).tolist():
                inside = at == place
                for v in range(len(names)):
                    times = seen[inside, 3 * v]
                    n = times.sum()
                    mean = times @ x[inside] / n if n else np.zeros(x.shape[1])
                    squares = times @ (x[inside] - mean) ** 2
                    own = np.concatenate([[n, times @ seen[inside, 3 * v + 1]], mean, squares])
                    key = place * len(names) + v
                    sums[key] = merged(sums[key], own) if key in sums else own
        return sums

    found = _summed(ready, partial, merged)
    return {(names[i % len(names)], *places[i // len(names)]): v for i, v in found.items()}


def fit_all(rows: DataFrame, features: Sequence[str], views: Mapping[str, View], jobs: Sequence[Job]) -> dict[tuple, Found]:
    """L2 logistic regressions on population-standardised features, all in one pass per Newton step.

    Each minimises 0.5 |w|^2 + c * sum(weight * loss); the intercept is free. ``rows`` (segment, fold, features)
    should be materialised. A fit without both classes, or one that does not converge, is an error. Null or
    NaN features are an error as well.
    """
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    ready = _ready(rows.where(F.when(bad, F.raise_error(F.lit("null or NaN feature in a fit"))).otherwise(F.lit(True)).cast("boolean")),
                   features, views)
    names = list(views)
    parts = moments(ready, names)
    found: list[Found] = []
    for job in jobs:
        total = None
        for (view, segment, fold), m in sorted(parts.items(), key=lambda e: str(e[0])):
            if view == job.view and fold != job.fold and job.segment in (None, segment):
                total = m if total is None else merged(total, m)
        if total is None or not 0 < total[1] < total[0]:
            raise ValueError(f"fit {job.key}: training rows need both classes")
        use = job.features or tuple(range(len(features)))
        size = len(features)
        mean, scale = total[2 : 2 + size][list(use)], np.sqrt(total[2 + size :][list(use)] / total[0])
        scale = np.where(scale > 0, scale, 1.0)
        if not job.standardise:
            mean, scale = np.zeros(len(use)), np.ones(len(use))
        found.append(Found(use, mean, scale, np.zeros(len(use)), 0.0, int(total[0]), int(total[1])))

    def class_weights(job: Job, f: Found) -> tuple[float, float]:
        n, p = f.rows, f.positives
        if job.weights == "balanced":
            return n / (2.0 * (n - p)), n / (2.0 * p)
        return (1.0, math.sqrt((n - p) / p)) if job.weights == "sqrt" else (1.0, 1.0)

    both = [class_weights(j, f) for j, f in zip(jobs, found)]

    def pass_over(active: Sequence[int], at: Sequence[np.ndarray]) -> dict[int, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                x, seen = _numbers(batch, "x"), _numbers(batch, "seen")
                fold = batch.column("fold").to_numpy()
                segment = np.array(batch.column("segment").to_pylist(), object)
                for i in active:
                    job, f, w, v = jobs[i], found[i], at[i], 3 * names.index(jobs[i].view)
                    inside = seen[:, v] > 0
                    if job.fold is not None:
                        inside &= fold != job.fold
                    if job.segment is not None:
                        inside &= segment == job.segment
                    if not inside.any():
                        continue
                    z = np.column_stack([(x[inside][:, list(f.features)] - f.mean) / f.scale, np.ones(int(inside.sum()))])
                    y = seen[inside, v + 1]
                    weight = seen[inside, v] * seen[inside, v + 2] * np.where(y == 1, both[i][1], both[i][0])
                    margin = z @ w
                    p = 0.5 * (1 + np.tanh(0.5 * margin))
                    loss = (weight * (np.logaddexp(0, margin) - y * margin)).sum()
                    slope = z.T @ (weight * (p - y))
                    bend = (z * (weight * p * (1 - p))[:, None]).T @ z
                    own = np.concatenate([[loss, weight.sum()], slope, bend.ravel()])
                    sums[i] = sums[i] + own if i in sums else own
            return sums

        return _summed(ready, partial, np.add)

    at = [np.zeros(len(f.features) + 1) for f in found]
    before: list[tuple[float, np.ndarray] | None] = [None] * len(jobs)
    active = list(range(len(jobs)))
    for _ in range(STEPS):
        sums = pass_over(active, at)
        still = []
        for i in active:
            w, size, c = at[i], len(at[i]), jobs[i].c
            penalty = np.append(np.ones(size - 1), 0.0)
            loss = c * sums[i][0] + 0.5 * (penalty * w * w).sum()
            slope = c * sums[i][2 : 2 + size] + penalty * w
            bend = c * sums[i][2 + size :].reshape(size, size) + np.diag(penalty)
            if before[i] is not None and loss > before[i][0] + 1e-12 * abs(before[i][0]):
                at[i] = (w + before[i][1]) / 2  # too long a step: half of it
                still.append(i)
                continue
            found[i].coef, found[i].intercept = w[:-1], float(w[-1])
            found[i].steepest = float(np.abs(slope).max() / (c * sums[i][1]))
            step = np.linalg.lstsq(bend, slope, rcond=None)[0]
            before[i] = loss, w
            if slope @ step > ENOUGH * ENOUGH * (1 + abs(loss)) and found[i].steepest > 1e-13:
                at[i] = w - step
                still.append(i)
        active = still
        if not active:
            return dict(zip([j.key for j in jobs], found))
    raise RuntimeError(f"fits {[jobs[i].key for i in active]} have not converged in {STEPS} steps")


def margins(rows: DataFrame, features: Sequence[str], fits: Mapping[tuple, Found], keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Give each row ``z`` of every fit whose ``on`` columns (among ``keys``) it has: all fits in one pass."""
    spark = rows.sparkSession
    types = {"fold": "int", "outer": "int"}
    table = [(*key, *f.raw(len(features))) for key, f in fits.items()]
    ddl = ", ".join(f"{k} {types.get(k, 'string')}" for k in keys) + ", _w array<double>, _b double"
    weights = small_table(spark.createDataFrame(table, ddl))
    x = F.array(*[F.col(f).cast("double") for f in features])
    dot = F.aggregate(F.zip_with(x, "_w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(weights, list(on)).withColumn("z", dot + F.col("_b")).drop("_w", "_b")


def sigmoid_maps(
    df: DataFrame, keys: Sequence[str], score: str = "score", c: float | None = None, smooth: bool = True, fold: str | None = None,
) -> DataFrame:
    """One-feature logistic map per ``keys``, fitted for all of them at once: (keys, slope, intercept, steepest).

    Rows enter as counts per (keys, score, label). With ``fold``, each map is fitted for every fold value on
    the rows of the others, and ``fold`` is one more key of the result. ``smooth`` replaces the labels by
    (n1 + 1) / (n1 + 2) and 1 / (n0 + 2); ``c`` adds the penalty 0.5 slope^2 to c times the loss. Each step
    is one aggregation over the counts with five sums per map.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, *([fold] if fold else []), F.col(score).alias("_s")).agg(
        F.sum(F.lit(1.0)).alias("_n"), F.sum(F.col("label").cast("double")).alias("_p"))
    if fold:
        folds = [r[0] for r in counts.select(fold).distinct().collect()]
        others = F.filter(F.array(*[F.lit(k) for k in folds]), lambda k: k != F.col(fold))
        counts = counts.withColumn("_k", F.explode(others)).drop(fold).withColumnRenamed("_k", fold)
        keys.append(fold)
    counts = counts.cache()
    totals = counts.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_p").alias("p"), (F.sum(F.col("_s") * F.col("_n")) / F.sum("_n")).alias("m")).collect()
    state = {tuple(r[k] for k in keys): [0.0, 0.0, r["n"], r["p"], r["m"]] for r in totals}
    if any(not 0 < s[3] < s[2] for s in state.values()):
        raise ValueError("a sigmoid map needs both classes")
    types = {k: t for k, t in counts.dtypes}
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", _a double, _b double, _high double, _low double"
    steepest: dict[tuple, float] = {}
    best: dict[tuple, tuple[float, float, float]] = {}
    active = set(state)
    for _ in range(STEPS):
        rows = []
        for k in active:
            a, b, n, p, _ = state[k]
            rows.append((*k, a, b, *(((p + 1) / (p + 2), 1 / (n - p + 2)) if smooth else (1.0, 0.0))))
        at = F.broadcast(df.sparkSession.createDataFrame(rows, ddl))
        z = F.col("_a") * F.col("_s") + F.col("_b")
        p = sigmoid(z)
        target = F.col("_p") * F.col("_high") + (F.col("_n") - F.col("_p")) * F.col("_low")
        off, bend = F.col("_n") * p - target, F.col("_n") * p * (1 - p)
        loss = F.col("_n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - target * z
        sums = counts.join(at, keys).groupBy(*keys).agg(
            F.sum(loss).alias("l"), F.sum(off * F.col("_s")).alias("g1"), F.sum(off).alias("g0"),
            F.sum(bend * F.col("_s") * F.col("_s")).alias("h11"), F.sum(bend * F.col("_s")).alias("h10"),
            F.sum(bend).alias("h00")).collect()
        for r in sums:
            k = tuple(r[x] for x in keys)
            a, b, n = state[k][:3]
            weight = c if c is not None else 1.0
            slope = np.array([r["g1"], r["g0"]]) * weight + ([a, 0.0] if c is not None else 0.0)
            curve = np.array([[r["h11"], r["h10"]], [r["h10"], r["h00"]]]) * weight
            value = r["l"] * weight
            if c is not None:
                curve[0, 0] += 1.0
                value += 0.5 * a * a
            if k in best and value > best[k][0] + 1e-12 * abs(best[k][0]):
                state[k][:2] = (a + best[k][1]) / 2, (b + best[k][2]) / 2
                continue
            best[k], steepest[k] = (value, a, b), float(np.abs(slope).max() / (weight * n))
            step = np.linalg.lstsq(curve, slope, rcond=None)[0]
            if steepest[k] <= 1e-12 or slope @ step <= 1e-20 * (1 + abs(value)):
                active.discard(k)
            else:
                state[k][:2] = a - float(step[0]), b - float(step[1])
        if not active:
            break
    counts.unpersist()
    if active:
        raise RuntimeError(f"sigmoid maps of {sorted(active, key=str)} have not converged")
    out = [(*k, v[1], v[2], steepest[k]) for k, v in best.items()]
    names = ", ".join(f"{k} {types[k]}" for k in keys)
    return df.sparkSession.createDataFrame(out, f"{names}, slope double, intercept double, steepest double")
