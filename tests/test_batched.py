"""Batched logistic fits, grouped sigmoid maps, and candidate specifications with their ledger."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linetriage.operators import batched, groups, models, specs
from test_models import data, newton

NAMES = ["a", "b", "c"]


def frame(n=300):
    """Rows of two segments, some of them copies of one input with another label."""
    rows = data(n).assign(segment=lambda d: np.where(d.row_id % 2 == 0, "even", "odd"))
    rows.loc[rows.row_id % 10 >= 8, NAMES] = rows.loc[(rows.row_id // 10 * 10).loc[rows.row_id % 10 >= 8], NAMES].to_numpy()
    return rows.drop(columns=["group_id", "fold"])


def grouped(spark, local):
    made = groups.with_groups(spark.createDataFrame(local), NAMES)
    return made.withColumn("fold", (F.col("first_row") / 10 % 3).cast("int")).cache()


def plain_fit(local, c, mode, times, label, weight):
    x, m = local[NAMES].to_numpy(), times.to_numpy().astype(float)
    mean = (m[:, None] * x).sum(0) / m.sum()
    scale = np.sqrt((m[:, None] * (x - mean) ** 2).sum(0) / m.sum())
    n, y = m.sum(), label.to_numpy().astype(float)
    p = (m * y).sum()
    by_class = {"balanced": (n / (2 * (n - p)), n / (2 * p)), "sqrt": (1, np.sqrt((n - p) / p)), None: (1, 1)}[mode]
    w = m * weight.to_numpy() * np.where(y == 1, by_class[1], by_class[0])
    return newton((x - mean) / scale, y, w, c)


SPECS = {
    "plain": specs.Spec("logistic", 0.1, "balanced"), "sqrt": specs.Spec("logistic", 1.0, "sqrt", pooled=True),
    "event": specs.Spec("logistic", 0.1, "balanced", event=True), "five": specs.Spec("logistic", 0.1, None, oversample=5),
    "both": specs.Spec("logistic", 1.0, "sqrt", event=True, oversample=3), "shared": specs.Spec("logistic", 0.1, "balanced", group_weight=True),
}


def test_all_fits_together_equal_one_by_one(spark):
    local = frame()
    rows = grouped(spark, local)
    facts = rows.select("row_id", "first_row", "group_rows", "group_positives", "fold").toPandas().set_index("row_id")
    local = local.join(facts, on="row_id")
    scores, ledger, fits = specs.spec_scores(rows, NAMES, SPECS, range(3), 7)
    book = ledger.toPandas().set_index(["candidate", "fold"]).sort_index()
    for (name, k, s), found in fits.items():
        spec = SPECS[name]
        training = local[(local.fold != k) & ((local.segment == s) | (s is None))]
        label = (training.group_positives > 0).astype(int) if spec.event else training.label
        times = np.where(label == 1, spec.oversample, 1) * (np.where(training.row_id == training.first_row, 1, 0) if spec.event else 1)
        times = pd.Series(times, training.index)
        weight = 1 / training.group_rows if spec.group_weight else pd.Series(1.0, training.index)
        want = plain_fit(training, spec.c, spec.weights, times, label, weight)
        assert np.allclose([*found.coef, found.intercept], want, atol=1e-7), (name, k, s)
        assert found.steepest < 1e-9
        entry = book.loc[(name, k)]
        entry = (entry if spec.pooled else entry[entry.segment == s]).iloc[0]
        assert (entry.training_rows, entry.training_positives) == (len(training), training.label.sum())
        assert (entry.fit_rows, entry.fit_positives) == (times.sum(), (times * label).sum())
    out = scores.toPandas()
    assert len(out) == len(SPECS) * len(local) and not out.duplicated(["candidate", "row_id"]).any()
    assert out.groupby(["candidate", "group_id"]).score.nunique().max() == 1
    old = models.fit_logistic(rows.where((F.col("fold") != 1) & (F.col("segment") == "odd")), NAMES, 0.1)
    assert np.allclose([r[3] for r in old], [*fits[("plain", 1, "odd")].coef, fits[("plain", 1, "odd")].intercept], atol=1e-5)


def test_other_kinds_fit_the_view_and_write_the_ledger(spark):
    rows = grouped(spark, frame(200))
    chosen = {"forest": specs.Spec("forest", event=True, trees=5, depth=2), "boosted": specs.Spec("boosted", trees=3, depth=1, oversample=4),
              "prior": specs.Spec("prior", pooled=True), "more": specs.Spec("logistic", engineered=True)}
    named = {"ratios": {"r": ("a", "b")}, "spread": ("all", NAMES), "differences": {"d": ("a", "c")}}
    scores, ledger, fits = specs.spec_scores(rows, NAMES, chosen, range(3), 1, named)
    out, book = scores.toPandas(), ledger.toPandas()
    assert len(out) == 800 and out.score.between(0, 1).all() and len(book) == 6 + 6 + 3 + 6
    assert {len(f.coef) for f in fits.values()} == {7}
    copies = rows.toPandas()
    firsts = copies[copies.row_id == copies.first_row]
    want = {(k, s): len(firsts[(firsts.fold != k) & (firsts.segment == s)]) for k in range(3) for s in ("even", "odd")}
    assert {(r.fold, r.segment): r.fit_rows for r in book[book.candidate == "forest"].itertuples()} == want
    with pytest.raises(ValueError, match="both classes"):
        specs.spec_scores(rows.where("label = 0"), NAMES, {"x": specs.Spec("logistic")}, range(3), 1)
    with pytest.raises(Exception, match="null or NaN"):
        specs.spec_scores(rows.withColumn("a", F.when(F.col("row_id") != 7, F.col("a"))), NAMES, {"x": specs.Spec("logistic")}, range(3), 1)


@pytest.mark.parametrize("c, smooth", [(None, True), (10.0, False)])
def test_grouped_maps_equal_single_ones(spark, c, smooth):
    local = data(400).assign(score=lambda d: d.a.round(1), segment=lambda d: np.where(d.row_id % 3 == 0, "x", "y"), fold=lambda d: d.row_id % 4)
    found = batched.sigmoid_maps(spark.createDataFrame(local), ["segment"], c=c, smooth=smooth, fold="fold").toPandas()
    assert len(found) == 8
    for r in found.itertuples():
        fit = local[(local.segment == r.segment) & (local.fold != r.fold)]
        p, n = fit.label.sum(), len(fit)
        y = np.where(fit.label == 1, (p + 1) / (p + 2), 1 / (n - p + 2)) if smooth else fit.label.to_numpy()
        design, w = np.column_stack([fit.score, np.ones(n)]), np.zeros(2)
        ridge = np.diag([1.0 if c else 0.0, 0.0])
        for _ in range(60):
            q = 1 / (1 + np.exp(-design @ w))
            w = w - np.linalg.solve(ridge + (c or 1) * design.T @ (design * (q * (1 - q))[:, None]), ridge @ w + (c or 1) * design.T @ (q - y))
        assert np.allclose([r.slope, r.intercept], w, atol=1e-7) and r.steepest < 1e-10
