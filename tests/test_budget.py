import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linetriage.operators import budget, quality, resample

SMALL = [("left", 0, 0.9, 1), ("left", 1, 0.8, 0), ("left", 2, 0.7, 0), ("right", 0, 0.6, 0), ("right", 1, 0.6, 1), ("right", 2, 0.6, 0)]


def frame(spark, rows=SMALL, model="m", shuffled=False):
    rows = rows[::-1] if shuffled else rows
    return spark.createDataFrame(
        [(s, i, x, y, f"{s}:{i}", i % 2, model, 1) for s, i, x, y in rows],
        "segment string, row_id long, score double, label int, group_id string, fold int, model string, seed int",
    )


def chosen(df, *args):
    return {(r.segment, r.row_id) for r in budget.select(df, *args).where("selected").collect()}


@pytest.mark.parametrize("shuffled", [False, True])
def test_selection_does_not_depend_on_row_order(spark, shuffled):
    df = frame(spark, shuffled=shuffled)
    assert chosen(df, 0.1, budget.GLOBAL) == {("left", 0)}
    assert chosen(df, 0.1, budget.PER_SEGMENT) == {("left", 0), ("right", 0)}


@pytest.mark.parametrize("fraction", [0.0, -0.1, 1.1])
def test_fraction_outside_range_is_refused(spark, fraction):
    with pytest.raises(ValueError):
        budget.select(frame(spark), fraction)


def test_unknown_policy_is_refused(spark):
    with pytest.raises(ValueError):
        budget.select(frame(spark), 0.1, "P_OTHER")


def test_tie_bounds_of_equal_scores(spark):
    rows = {r.segment: r for r in budget.tie_bounds(frame(spark), fractions=[0.1]).collect()}
    tied = rows["right"]
    assert (tied.minimum_found, tied.maximum_found) == (0, 1)
    assert tied.expected_found == pytest.approx(1 / 3)


def test_no_positives_give_null_not_zero(spark):
    table = budget.policy_table(frame(spark, [("left", 0, 0.4, 0), ("left", 1, 0.2, 0)]), fractions=[0.5], folds=False)
    for r in table.collect():
        assert r.recall is None and r.average_precision is None and r.roc_auc is None and r.lift is None
        assert r.precision == 0.0


def two_lines(extra=0.95):
    rows = []
    for s in ("left", "right"):
        for i in range(1, 11):
            score = 0.9 if i == 1 else 0.1
            if s == "right" and i == 3:
                score = extra
            rows.append((s, i, score, int(i <= 2)))
    return rows


def test_policy_summary(spark):
    table = budget.derived_policy_metrics(budget.policy_table(
        frame(spark, two_lines()), fractions=[0.1], policies=(budget.PER_SEGMENT,), folds=False))
    r = table.where("segment = 'all'").first()
    assert (r.rows, r.positives, r.k, r.tp, r.fp, r.fn, r.tn) == (20, 4, 2, 1, 1, 3, 15)
    assert (r.recall, r.precision, r.accuracy) == (0.25, 0.5, 0.8)
    assert r.f1 == pytest.approx(1 / 3)


def test_segment_ties_add_up(spark):
    bounds = budget.tie_bounds(frame(spark, two_lines(0.9)), fractions=[0.1], segments_only=True)
    r = {x.segment: x for x in bounds.collect()}["right"]
    assert (r.minimum_found, r.maximum_found, r.expected_found) == (0, 1, 0.5)
    total = budget.tie_totals(bounds, ["model", "seed"]).first()
    assert (total.tie_min_found, total.tie_max_found, total.tie_sensitive) == (1, 2, True)


def test_budget_arithmetic(spark):
    summary = spark.createDataFrame([(1913, 33, 192, 17)], "rows long, positives long, k long, found long")
    r = budget.derived_policy_metrics(summary).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (17, 175, 16, 1705)
    assert r.accuracy == pytest.approx(1722 / 1913)


def test_grid_matches_brute_force(spark):
    source = np.random.default_rng(5)
    rows = pd.DataFrame({
        "segment": source.choice(["a", "b", "c"], 400, p=[0.6, 0.3, 0.1]), "row_id": np.arange(400),
        "score": source.random(400).round(1), "label": (source.random(400) < 0.3).astype(int), "fold": np.arange(400) % 3,
    })
    rows["group_id"] = rows.segment + rows.score.astype(str)
    rows["model"], rows["seed"] = "m", 1
    got = budget.policy_table(spark.createDataFrame(rows), fractions=[0.15]).toPandas()
    ordered = rows.sort_values(["score", "segment", "row_id"], ascending=[False, True, True])
    for fold, segment in itertools.product([-1, 0, 1, 2], ["all", "a", "b", "c"]):
        part = ordered[((ordered.fold == fold) | (fold == -1)) & ((ordered.segment == segment) | (segment == "all"))]
        per = pd.concat([p.head(int(np.ceil(0.15 * len(p)))) for _, p in part.groupby("segment")])
        for policy, want in ((budget.GLOBAL, part.head(int(np.ceil(0.15 * len(part))))), (budget.PER_SEGMENT, per)):
            r = got[(got.fold == fold) & (got.segment == segment) & (got.policy == policy)].iloc[0]
            assert (r["rows"], r.k, r.found, r.groups) == (len(part), len(want), want.label.sum(), part.group_id.nunique())


def test_identical_scores_differ_by_nothing(spark):
    rows = [("left", i, s, y) for i, (s, y) in enumerate([(0.9, 1), (0.3, 0), (0.3, 0), (0.2, 0)])]
    rows += [("right", i, s, y) for i, (s, y) in enumerate([(0.8, 0), (0.6, 1), (0.1, 0)])]
    both = frame(spark, rows, "base").unionByName(frame(spark, rows, "same"))
    out = resample.paired_policy_bootstrap(both, "base", "same", 20, 7).collect()
    assert len(out) == 12
    for r in out:
        assert r.difference == 0 and r.valid_repeats + r.invalid_repeats == 20
        assert r.valid_repeats == 0 or (r.lower95 == 0 and r.upper95 == 0)
    assert any(r.invalid_repeats for r in out)


def test_paired_bootstrap_keeps_seeds_apart(spark):
    rows = [
        (seed, model, "ab"[i % 2], i, f"g{i // 2}", int(i % 5 == 0), ((i * (7 + 4 * seed + (model == "new"))) % 41) / 41)
        for seed in (1, 2) for model in ("old", "new") for i in range(40)]
    both = spark.createDataFrame(rows, "seed int, model string, segment string, row_id long, group_id string, label int, score double")
    got = resample.paired_policy_bootstrap(both, "old", "new", 6, 7, dims=["seed"]).collect()
    assert len(got) == 24 and {r.seed for r in got} == {1, 2}
    for seed in (1, 2):
        alone = resample.paired_policy_bootstrap(both.where(F.col("seed") == seed), "old", "new", 6, 7).collect()
        found = {(r.segment, r.policy, r.metric): r for r in got if r.seed == seed}
        for r in alone:
            other = found[r.segment, r.policy, r.metric]
            assert all(other[c] == pytest.approx(r[c], abs=1e-12) for c in ("lower95", "upper95", "difference", "valid_repeats"))


def test_poisson_weights_average_one(spark):
    groups = spark.range(2000).select(F.col("id").cast("string").alias("group_id"))
    total = resample.poisson_weights(groups, 5, 3).agg(F.sum("w")).first()[0]
    assert abs(total / 10_000 - 1) < 0.05


def test_smallest_sufficient_budget(spark):
    table = spark.createDataFrame(
        [(s, f, t) for s in (1, 2) for f, t in ((0.05, 9), (0.1, 12 + s), (0.2, 20))], "seed int, fraction double, tp long")
    assert budget.smallest_sufficient(table, ["seed"], F.col("tp") >= 12).first().recommended_fraction == 0.1
    assert budget.smallest_sufficient(table, ["seed"], F.col("tp") >= 99).first().recommended_fraction is None


def test_hypergeometric_reference(spark):
    from math import comb

    n, p, k, found = 946, 20, 95, 4
    r = resample.random_reference(spark.createDataFrame(
        [("x", n, p, k, found)], "segment string, rows long, positives long, k long, found long")).first()
    pmf = [comb(p, i) * comb(n - p, k - i) / comb(n, k) for i in range(p + 1)]
    cdf = np.cumsum(pmf)
    assert r.random_expected_found == pytest.approx(k * p / n)
    assert r.random_ge_observed == pytest.approx(sum(pmf[found:]))
    assert (r.random_lower95, r.random_upper95) == (int(np.argmax(cdf >= 0.025)), int(np.argmax(cdf >= 0.975)))


def test_average_precision_is_not_the_area_under_the_curve(spark):
    rows = [("a", i, s, y) for i, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.5, 1), (0.1, 0)])]
    r = quality.ranking_quality(frame(spark, rows), ["segment"]).first()
    assert r.average_precision == pytest.approx(1 / 3 * (1 + 2 / 4 + 3 / 5))
    pairs = [(p, q) for p in rows if p[3] for q in rows if not q[3]]
    assert r.roc_auc == pytest.approx(np.mean([(p[2] > q[2]) + 0.5 * (p[2] == q[2]) for p, q in pairs]))
