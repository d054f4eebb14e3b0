import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linetriage.operators import anomaly, batched, drift, models
from linetriage.operators.derive import linear_score


def data(n=240, seed=0):
    source = np.random.default_rng(seed)
    x = source.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 10.0, -1.0]
    z = 1.2 * x[:, 0] - 0.3 * (x[:, 1] - 10) - 1.0
    y = (source.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    frame = pd.DataFrame(x, columns=["a", "b", "c"])
    return frame.assign(label=y, row_id=np.arange(n), segment="s", fold=np.arange(n) % 3, group_id=[f"g{i}" for i in range(n)])


def newton(x, y, weight, c, steps=50):
    """Minimise 0.5 |w|^2 + c * sum(weight * logloss), intercept free."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = penalty @ w + c * design.T @ (weight * (p - y))
        hessian = penalty + c * design.T @ (design * (weight * p * (1 - p))[:, None])
        w = w - np.linalg.solve(hessian, gradient)
    return w


@pytest.mark.parametrize("c, mode", [(0.1, "balanced"), (1.0, None), (0.01, "balanced")])
def test_logistic_equals_newton(spark, c, mode):
    rows = data()
    fit = models.fit_logistic(spark.createDataFrame(rows), ["a", "b", "c"], c, mode)
    x = rows[["a", "b", "c"]].to_numpy()
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    y = rows.label.to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if mode else np.ones(len(y))
    want = newton(scaled, y, weight, c)
    assert np.allclose([r[3] for r in fit], want, atol=1e-5)


def test_fit_needs_both_classes(spark):
    with pytest.raises(ValueError, match="both classes"):
        models.fit_logistic(spark.createDataFrame(data().query("label == 0")), ["a"])


def test_every_row_is_scored_once_out_of_fold_by_other_folds(spark):
    rows = spark.createDataFrame(data()).cache()
    out = models.oof_scores(rows, ["a", "b", "c"], {"logistic": models.logistic(), "prior": models.prior()}, range(3), 1).toPandas()
    assert len(out) == 480 and not out.duplicated(["candidate", "row_id"]).any() and out.score.between(0, 1).all()
    local = data()
    for k in range(3):
        got = out[(out.candidate == "prior") & (out.fold == k)].score.unique()
        assert got == pytest.approx([local[local.fold != k].label.mean()])


def test_sigmoid_map_against_newton(spark):
    rows = data().assign(score=lambda d: d.a)
    slope, intercept = models.fit_sigmoid(spark.createDataFrame(rows))
    y = rows.label.to_numpy()
    p, q = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (p + 1) / (p + 2), 1 / (q + 2))
    design = np.column_stack([rows.a, np.ones(len(y))])
    w = np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (m * (1 - m))[:, None]), design.T @ (m - target))
    assert (slope, intercept) == pytest.approx(tuple(w), abs=1e-4)


def test_weights_survive_saving(spark, tmp_path):
    rows = spark.createDataFrame(data())
    weights = models.weights_table(spark, {"s": models.fit_logistic(rows, ["a", "b", "c"])})
    weights.write.parquet(str(tmp_path / "w"))
    r = drift.parity(linear_score(rows, weights, ["a", "b", "c"]), linear_score(
        rows, spark.read.parquet(str(tmp_path / "w")), ["a", "b", "c"]), ["row_id"], "score").first()
    assert r.max_abs_error <= 1e-12 and r.only_in_first == 0 and r.only_in_second == 0


def test_copies_get_equal_scores_from_trees(spark):
    rows = spark.createDataFrame(pd.concat([data(60), data(60).assign(row_id=lambda d: d.row_id + 1000)]))
    scorer = models.forest(5, 3, 1)(rows, ["a", "b", "c"], 1)
    spread = scorer(rows).groupBy("group_id").agg((F.max("score") - F.min("score")).alias("s"))
    assert spread.agg(F.max("s")).first()[0] <= 1e-12


def test_isolation_forest_finds_the_far_point(spark):
    rows = data(300).assign(label=0)
    rows.loc[5, ["a", "b", "c"]] = [40.0, 300.0, 9.0]
    rows.loc[5, "label"] = 1
    out = anomaly.isolation_oof(spark.createDataFrame(rows), ["a", "b", "c"], range(3), trees=20, seed=1).toPandas()
    assert len(out) == 300 and out.score.between(0, 1).all() and out.set_index("row_id").score.idxmax() == 5
    again = anomaly.isolation_oof(spark.createDataFrame(rows).repartition(5), ["a", "b", "c"], range(3), trees=20, seed=1).toPandas()
    assert np.allclose(out.sort_values("row_id").score, again.sort_values("row_id").score)


def test_tree_samples_are_bounded(spark):
    rows = spark.range(20_000).select(
        F.lit("s").alias("segment"), F.lit(0).alias("fold"), F.col("id").alias("row_id"), F.rand(1).alias("a"))
    samples = anomaly.tree_samples(rows, 10, 1)
    per = [r["count"] for r in samples.groupBy("tree").count().collect()]
    assert len(per) == 10 and set(per) == {anomaly.SAMPLE}


def test_leaking_and_unknown_folds_are_refused(spark):
    schema = "segment string, row_id long, group_id string, label int, fold int, x double"
    for rows in ([("a", 1, "g", 0, 0, 0.1), ("a", 2, "g", 1, 1, 0.2)], [("a", 1, "g", 0, 7, 0.1)], [("a", 1, "g", 0, None, 0.1)]):
        with pytest.raises(ValueError, match="fold"):
            models.oof_scores(spark.createDataFrame(rows, schema), ["x"], {"prior": models.prior()}, range(2), 1)


def test_the_best_margin_decides_in_the_union_route(spark):
    scores = spark.createDataFrame(
        [(0, "a", 1, 1, "p", 0.5), (0, "a", 1, 1, "q", 0.9), (0, "a", 2, 0, "p", 0.1), (0, "a", 2, 0, "q", 0.2)],
        "outer int, segment string, row_id long, label int, candidate string, score double")
    limits = spark.createDataFrame([(0, "a", "p", 0.6), (0, "a", "q", 0.7)], "outer int, segment string, candidate string, high_recall_threshold double")
    got = {r.row_id: (round(r.score, 6), r.decision) for r in models.union_route(scores, limits, ["outer", "segment"]).collect()}
    assert got == {1: (0.6, True), 2: (0.25, False)}


def test_queue_and_round_trip_use_all_embedding_features(spark, tmp_path, monkeypatch):
    from linetriage.plans import model_queries, views

    fitted, fit = [], models.fit_logistic
    monkeypatch.setattr(models, "fit_logistic", lambda rows, features, *more: fitted.append(tuple(features)) or fit(rows, features, *more))
    together, fit_all = [], batched.fit_all
    monkeypatch.setattr(batched, "fit_all", lambda rows, features, *more: together.append(tuple(features)) or fit_all(rows, features, *more))
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/embeddings.parquet")
    before = {r.row_id: r.ood_feature_count for r in model_queries.model_queue(spark, sf).collect()}
    far = min(before, key=lambda i: (before[i], i))
    # The row leaves the range in the last three features only.
    moved = F.when(F.col("vec_id") == far, F.concat(F.slice("embedding", 1, 61), F.array(*[F.lit(1e6).cast("float")] * 3)))
    source.withColumn("embedding", F.coalesce(moved, "embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = views.vectors(spark, str(tmp_path)).where(F.col("row_id") == far).first()
    assert rows["f60"] < 1e5 and rows["f61"] == rows["f63"] == 1e6
    monkeypatch.setattr(model_queries, "training_rows", lambda *a, f=model_queries.training_rows: _with_fold(f(*a), far))
    after = {r.row_id: r for r in model_queries.model_queue(spark, str(tmp_path)).collect()}
    assert after[far].ood_feature_count >= 3 and after[far].ood_flag
    assert model_queries.model_roundtrip(spark, sf).first()["max_abs_error"] <= 1e-12
    # The queue's fits of all folds and segments are made together, the round trip's one by one.
    assert len(together) == 2 and len(fitted) == 2 and {*together, *fitted} == {model_queries.VECTOR}
    assert len(before) == len(after) == source.count()


def _with_fold(made, row):
    """The moved row forms another group; it stays among the live rows."""
    rows, table = made
    return rows.withColumn("fold", F.when(F.col("row_id") == row, F.lit(4)).otherwise(F.col("fold"))), table


def test_logistic_candidates_are_fitted_together_with_the_same_scores(spark, monkeypatch):
    rows = spark.createDataFrame(data()).withColumn("inner_fold", F.col("row_id") % 3).drop("fold", "group_id").cache()
    features = ["a", "b", "c"]
    candidates = {"pooled": models.logistic(0.5), "own": models.per_segment(models.logistic(0.1, None), ["s"]), "prior": models.prior()}
    want = {}
    for name, c, weights in (("pooled", 0.5, "balanced"), ("own", 0.1, None)):
        for k in range(3):
            z = models.margin(models.fit_logistic(rows.where(F.col("inner_fold") != k), features, c, weights))
            for r in rows.where(F.col("inner_fold") == k).select("row_id", (1 / (1 + F.exp(-z))).alias("p")).collect():
                want[name, r.row_id] = r.p
    fits = []
    whole = models.batched.fit_all
    monkeypatch.setattr(models.batched, "fit_all", lambda *a: fits.append(len(a[3])) or whole(*a))
    monkeypatch.setattr(models, "fit_logistic", None)  # no fit by itself
    got = models.oof_scores(rows, features, candidates, range(3), 1, "inner_fold").collect()
    assert fits == [6] and len(got) == 3 * rows.count()
    scored = {(r.candidate, r.row_id): r.score for r in got if r.candidate != "prior"}
    assert scored.keys() == want.keys() and all(abs(scored[k] - want[k]) < 1e-4 for k in want)
    assert [c for c in ("inner_fold", "seed") if c in got[0]] == ["inner_fold", "seed"]
    final = models.fit_segments(rows, features, {"s": models.logistic(0.5)}, 1)["s"]
    assert fits == [6, 1] and final.stored.kind == "linear" and final(rows).where("score between 0 and 1").count() == rows.count()
