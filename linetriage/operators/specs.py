"""Candidates as specifications: the view of the training rows each fit sees, scores out of fold, and a ledger of fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import finite, sigmoid
from linetriage.operators import batched, derive, groups, models
from linetriage.operators.models import check_folds
from linetriage.session import cut_lineage

LEDGER = "candidate string, fold int, segment string, kind string, training_rows long, training_positives long, fit_rows long, fit_positives long, steepest double"


@dataclass(frozen=True)
class Spec:
    """One candidate. ``event``: one row per group, positive if any is; ``oversample``: positives counted so often;
    ``group_weight``: rows of a group share one weight; ``engineered``: with the derived columns; ``pooled``:
    one fit for all segments instead of one each."""

    kind: str  # logistic, forest, boosted, kernel or prior
    c: float = 0.1
    weights: str | None = "balanced"
    event: bool = False
    oversample: int = 1
    group_weight: bool = False
    engineered: bool = False
    pooled: bool = False
    depth: int = 3
    trees: int = 200

    def candidate(self) -> models.Candidate:
        if self.kind == "forest":
            return models.forest(self.trees, self.depth, 8, self.weights)
        if self.kind == "boosted":
            return models.boosted(self.depth, self.trees, weights=self.weights)
        if self.kind == "kernel":
            return models.fourier_svc(self.c)
        if self.kind == "prior":
            return models.prior()
        raise ValueError(f"unknown kind {self.kind}")


def view_columns(spec: Spec) -> batched.View:
    """The view as columns on rows with their group's attributes (first_row, group_rows, group_positives)."""
    label = F.when(F.col("group_positives") > 0, 1).otherwise(0) if spec.event else F.col("label")
    times: Column = F.when(label == 1, spec.oversample).otherwise(1)
    if spec.event:
        times = F.when(F.col("row_id") == F.col("first_row"), times).otherwise(0)
    return batched.View(times, label, 1.0 / F.col("group_rows") if spec.group_weight else None)


def training_view(rows: DataFrame, spec: Spec, features: Sequence[str]) -> DataFrame:
    """The rows a fit sees, as rows: groups collapsed to events, positives repeated. Scoring never uses it."""
    fit = groups.collapse_events(rows, features) if spec.event else rows
    return groups.oversample(fit, spec.oversample) if spec.oversample > 1 else fit


def _once_per_input(scored: DataFrame, rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Scores of the first row of every group, given to all its rows; a score that is none is an error."""
    good = finite(F.col("score")) & F.col("score").between(0.0, 1.0)
    fault = F.raise_error(F.concat(F.lit("no score between 0 and 1 from "), F.col("candidate"))).cast("double")
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("score")).otherwise(fault)
    firsts = scored.select("candidate", "group_id", checked.alias("score"))
    return rows.select(*identity).join(firsts, "group_id").select(*identity, "candidate", "score")


def spec_scores(
    rows: DataFrame, features: Sequence[str], specs: Mapping[str, Spec], folds: Sequence[int], seed: int,
    engineering: Mapping | None = None, threads: int = 4,
) -> tuple[DataFrame, DataFrame, dict]:
    """Fit every spec without each fold and score that fold; returns scores, the ledger of fits, the linear fits.

    ``rows`` are materialised rows of ``groups.with_groups`` with ``fold``. All logistic specs are fitted
    together in one pass per step; other kinds by a job each. Every distinct input of a fold is scored once.
    The ledger has a row per fit with the rows and positives before and after its view.
    """
    check_folds(rows, "fold", folds)
    derived: list[str] = []
    if any(s.engineered for s in specs.values()):
        if not engineering:
            raise ValueError("engineered specs need their columns named")
        wide = derive.engineered(rows, **engineering)
        derived = [c for c in wide.columns if c not in rows.columns]
        rows = wide
    every = [*features, *derived]
    plain = tuple(range(len(features)))
    segments = sorted(r[0] for r in rows.select("segment").distinct().collect())
    firsts = rows.where(F.col("row_id") == F.col("first_row"))
    identity = ["segment", "row_id", "group_id", "label", "fold"]
    sizes = {(r["segment"], r["fold"]): (r["n"], r["p"]) for r in rows.groupBy("segment", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}

    def before(fold: int, segment: str | None) -> tuple[int, int]:
        parts = [v for (s, k), v in sizes.items() if k != fold and segment in (None, s)]
        return sum(n for n, _ in parts), sum(p for _, p in parts)

    ledger: list[tuple] = []
    scored: list[DataFrame] = []
    jobs, views = [], {}
    for name, spec in specs.items():
        if spec.kind == "logistic":
            views[name] = view_columns(spec)
            for k in folds:
                for s in [None] if spec.pooled else segments:
                    jobs.append(batched.Job((name, int(k), s), name, spec.c, spec.weights, int(k), s,
                                            features=None if spec.engineered or not derived else plain))
    fits = batched.fit_all(rows, every, views, jobs) if jobs else {}
    if fits:
        each = {}
        for (name, k, s), f in fits.items():
            ledger.append((name, k, s, "logistic", *before(k, s), f.rows, f.positives, f.steepest))
            each |= {(name, k, t): f for t in ([s] if s else segments)}
        z = batched.margins(firsts, every, each, ("candidate", "fold", "segment"), ("fold", "segment"))
        scored.append(z.select("candidate", "group_id", sigmoid(F.col("z")).alias("score")))

    def one(task: tuple[str, int, str | None]) -> tuple[DataFrame, tuple]:
        name, k, s = task
        spec, inside = specs[name], F.lit(True) if task[2] is None else F.col("segment") == task[2]
        use = every if spec.engineered else list(features)
        fit = training_view(rows.where((F.col("fold") != k) & inside), spec, use)
        count = fit.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
        score = spec.candidate()(fit, use, seed)(firsts.where((F.col("fold") == k) & inside))
        entry = (name, k, s, spec.kind, *before(k, s), count["n"], count["p"], None)
        return score.select(F.lit(name).alias("candidate"), "group_id", "score"), entry

    tasks = [(n, int(k), s) for n, spec in specs.items() if spec.kind != "logistic"
             for k in folds for s in ([None] if spec.pooled else segments)]
    with ThreadPoolExecutor(threads) as pool:
        for frame, entry in pool.map(one, tasks):
            scored.append(frame)
            ledger.append(entry)
    out = _once_per_input(reduce(DataFrame.unionByName, scored), rows, identity)
    return out, rows.sparkSession.createDataFrame(ledger, LEDGER), fits


def nested_run(
    rows: DataFrame, features: Sequence[str], specs: Mapping[str, Spec], inner: DataFrame, outer: Sequence[int],
    reference: str, seed: int, engineering: Mapping | None = None, threads: int = 4,
) -> models.NestedRun:
    """``models.nested_run`` over specifications: the logistic fits of an outer fold's inner folds are made together, and
    the run keeps the ledger of all fits. Their ``outer`` is the outer fold, null for the fits that score the outer folds."""
    def part(training: DataFrame, folds: Sequence[int], k: int | None) -> tuple[DataFrame, DataFrame]:
        scores, fits, _ = spec_scores(training, features, specs, folds, seed, engineering, threads)
        return cut_lineage(scores), fits.withColumn("outer", F.lit(k).cast("int"))

    ledgers, parts = [], []
    for k in outer:
        placed = cut_lineage(rows.where(F.col("fold") != k).drop("fold").join(
            inner.where(F.col("outer") == k).select("group_id", F.col("inner_fold").alias("fold")), "group_id"))
        count = placed.agg(F.max("fold")).first()[0] + 1
        scores, ledger = part(placed, range(count), k)
        parts.append(scores.withColumn("outer", F.lit(k)).withColumnRenamed("fold", "inner_fold"))
        ledgers.append(ledger)
    scores, ledger = part(rows, outer, None)
    return models.routed_run(
        reduce(DataFrame.unionByName, parts), scores.withColumn("outer", F.col("fold")), list(specs), reference,
        reduce(DataFrame.unionByName, [*ledgers, ledger]))
