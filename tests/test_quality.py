import math

import pytest
from pyspark.sql import functions as F

from linetriage.operators import choose, derive, drift, joins, quality


def scores(spark, pairs, scope="m"):
    return spark.createDataFrame([(scope, float(s), y) for s, y in pairs], "model string, score double, label int")


def test_reliability_keeps_empty_bins_and_puts_one_in_the_last(spark):
    rows = quality.reliability(scores(spark, [(0.0, 0), (0.01, 1), (1.0, 1)]), ["model"]).orderBy("bin").collect()
    assert [r.rows for r in rows] == [1, 1, 0, 0, 0, 0, 1]
    assert rows[2].mean_probability is None and rows[2].observed_rate is None
    assert rows[6].observed_rate == 1.0


def test_same_order_but_lower_loss(spark):
    a = quality.probability_quality(scores(spark, [(0.4, 0), (0.8, 1)]), ["model"]).first()
    b = quality.probability_quality(scores(spark, [(0.1, 0), (0.9, 1)]), ["model"]).first()
    assert b.brier < a.brier and b.log_loss < a.log_loss
    assert a.log_loss == pytest.approx(-(math.log(0.6) + math.log(0.8)) / 2)


def test_thresholds(spark):
    r = quality.best_thresholds(scores(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)]), ["model"]).first()
    assert r.high_recall_threshold == 0.7 and r.inner_f1 == pytest.approx(0.8)


def test_f2_threshold_against_brute_force(spark):
    import numpy as np

    source = np.random.default_rng(3)
    pairs = [(round(float(s), 2), int(source.random() < s)) for s in source.random(200)]
    s, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    best, at = -1.0, None
    for t in np.unique(np.quantile(s, np.linspace(0, 1, 201))):
        tp, k = int(y[s >= t].sum()), int((s >= t).sum())
        f2 = 5 * tp / (4 * y.sum() + k)
        if f2 > best + 1e-12:
            best, at = f2, t
    r = quality.best_f2_threshold(scores(spark, pairs), ["model"]).first()
    assert r.f2 == pytest.approx(best) and r.f2_threshold == pytest.approx(at)


def test_confusion_uses_zero_where_ranking_uses_null(spark):
    rows = scores(spark, [(0.1, 0), (0.2, 0)]).withColumn("decision", F.lit(False))
    r = quality.confusion(rows, ["model"]).first()
    assert (r.recall, r.precision, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_null_bands_stay(spark):
    rows = spark.createDataFrame(
        [("a", 1, True, "g1", "lo"), ("a", 0, False, "g2", None)],
        "segment string, label int, alert boolean, group_id string, band string")
    out = {r.bands: r for r in quality.slices(rows, {"band": ["band"]}).collect()}
    assert set(out) == {"lo", "null"} and out["null"].false_negative_rate is None and out["lo"].small_positive_sample


def candidates(spark, rows):
    return spark.createDataFrame(rows, (
        "outer int, segment string, candidate string, found long, average_precision double, roc_auc double, "
        "inner_f1 double, f1_recall double, high_recall_precision double"))


def test_guarded_route_keeps_the_reference(spark):
    table = candidates(spark, [
        (0, "a", "reference", 3, 0.2, 0.7, 0.3, 0.4, 0.1), (0, "a", "other", 5, 0.1, 0.8, 0.2, 0.4, 0.1)])
    got = {r.route: r.winner for r in choose.routes(table, ["outer", "segment"], "reference", ["reference", "other"]).collect()}
    assert got["nested_recall"] == "other" and got["nested_guarded"] == "reference"
    assert got["nested_f1"] == "reference" and got["nested_high_recall"] == "reference"


def test_full_tie_goes_to_the_frozen_order(spark):
    table = spark.createDataFrame([("k", "b", 2), ("k", "a", 2)], "key string, candidate string, found long")
    assert choose.best(table, ["key"], ["found"], ["b", "a"]).first().candidate == "b"
    with pytest.raises(Exception, match="unknown candidate"):
        choose.best(table, ["key"], ["found"], ["b"]).collect()


def test_incomplete_pair_is_refused(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.3), (2, "a", 0.4)], "row_id long, candidate string, score double")
    with pytest.raises(Exception, match="incomplete scores"):
        joins.candidate_pairs(rows, ["row_id"], ["a", "b"]).collect()


def test_one_to_one_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="left side"):
        joins.one_to_one(a, b, ["k"])
    with pytest.raises(Exception, match="no partner"):
        joins.left_complete(spark.createDataFrame([(1,), (3,)], "k int"), b, ["k"], "v").collect()


@pytest.mark.parametrize("change, rule", [
    (None, None), ({3: ("a", 0)}, "merged_groups"), ({1: ("z", 0)}, "split_groups"), ({2: ("b", 1)}, "changed_labels"),
])
def test_group_bijection(spark, change, rule):
    base = {0: ("a", 0), 1: ("a", 0), 2: ("b", 0), 3: ("c", 1)}
    names = {"a": "x", "b": "y", "c": "w", "z": "v"}
    other = {**base, **(change or {})}
    ours = spark.createDataFrame([(i, g, y) for i, (g, y) in base.items()], "row_id long, group_id string, label int")
    theirs = spark.createDataFrame([(i, names[g], y) for i, (g, y) in other.items()], "row_id long, group_id string, label int")
    broken = {r.rule for r in joins.group_bijection(ours, theirs, ["row_id"]).where("failed_rows > 0").collect()}
    assert (rule in broken) if rule else not broken
    if rule:
        with pytest.raises(ValueError):
            joins.rename_groups(ours, theirs, ["row_id"])
    else:
        assert {r.group_id for r in joins.rename_groups(ours, theirs, ["row_id"]).collect()} == {"x", "y", "w"}


def test_ks_and_drift(spark):
    fit = spark.createDataFrame([("a", float(i)) for i in range(10)], "segment string, x double")
    live = spark.createDataFrame([("a", float(i + 5)) for i in range(10)], "segment string, x double")
    assert drift.ks_distance(fit, live, ["x"]).first().ks == pytest.approx(0.5)
    r = drift.standardisation_drift(fit, ["x"]).first()
    assert r.max_abs_mean == 4.5 and r.max_abs_std_minus_one == pytest.approx(math.sqrt(8.25) - 1)


def test_run_difference_respects_tolerance_and_null(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-13), ("y", None), ("w", 2.0)], "k string, v double")
    assert {r.k for r in drift.run_difference(a, b, "k", "v", 1e-12).collect()} == {"z", "w"}


def test_engineered_features_stay_finite(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 2.0)], "a double, b double, c double")
    r = derive.engineered(rows, {"r": ("a", "b")}, ("m", ["a", "b", "c"]), {"d": ("c", "a")}).first()
    assert (r.r, r.m_mean, r.m_spread, r.d) == (1e8, 1.0, 2.0, 1.0)


def test_score_once_per_distinct_input(spark):
    rows = spark.createDataFrame([(1, 0.8), (2, 0.8), (3, 0.7)], "row_id long, x double")
    seen = []

    def score(inputs):
        seen.append(inputs.count())
        return inputs.withColumn("score", F.col("x"))

    got = {r.row_id: r.score for r in derive.score_distinct(rows, ["x"], score).collect()}
    assert seen == [2] and got == {1: 0.8, 2: 0.8, 3: 0.7}
