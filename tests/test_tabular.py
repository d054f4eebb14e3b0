"""The tabular baseline against plain solves, and its defined results for missing and new values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linetriage.operators import quality, tabular

SCHEMA = "row_id long, a double, b double, s string, t string, y double, k string"


def table(n=300, seed=3):
    source = np.random.default_rng(seed)
    a, b = source.normal(5.0, 2.0, n), source.normal(-1e4, 30.0, n)
    s, t = source.choice(["u", "v", "w"], n), source.choice(["x", "y"], n)
    y = 3 * a - 0.1 * b + (s == "v") * 4 - (t == "x") + source.normal(0, 0.5, n)
    k = np.where(y > np.quantile(y, 0.7), "high", np.where(y > np.quantile(y, 0.3), "mid", "low"))
    frame = pd.DataFrame({"row_id": np.arange(n), "a": a, "b": b, "s": s, "t": t, "y": y, "k": k}).astype(object)
    frame.loc[source.choice(n, 20, replace=False), "a"] = None
    frame.loc[source.choice(n, 20, replace=False), "s"] = None
    return frame


def design(frame):
    a = frame.a.astype(float)
    x = [a.fillna(a.median()), frame.b.astype(float)]
    x = [(v / v.std(ddof=0)).to_numpy() for v in x]
    s = frame.s.fillna(frame.s.value_counts().sort_index().idxmax())
    return np.column_stack(x + [(s == v).to_numpy(float) for v in "uvw"] + [(frame.t == v).to_numpy(float) for v in "xy"])


def rows_of(spark, frame):
    return spark.createDataFrame([tuple(r) for r in frame.itertuples(index=False)], SCHEMA)


@pytest.mark.parametrize("solved", [tabular.SOLVED, 0])
def test_ridge_equals_the_plain_solve(spark, solved):
    frame = table()
    rows = rows_of(spark, frame)
    got = tabular.fit(rows, ["a", "b"], ["s", "t"], "y", True, solved=solved).predict(rows).orderBy("row_id").toPandas()
    x, y = design(frame), frame.y.astype(float).to_numpy()
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    assert np.allclose(got.prediction, y.mean() + centred @ w, atol=1e-7 if solved else 1e-3)


def test_three_classes_are_level_and_measured(spark):
    frame = table()
    rows = rows_of(spark, frame)
    model = tabular.fit(rows, ["a", "b"], ["s", "t"], "k")
    got = model.predict(rows).orderBy("row_id").toPandas()
    p = np.vstack(got.probabilities)
    y = np.column_stack([(frame.k == c).to_numpy(float) for c in model.classes])
    x = design(frame)
    weights = {(r.term, r.value): r.coef for r in model.weights.collect()}
    w = np.vstack([model.slopes["a"], model.slopes["b"], *[weights["s", v] for v in "uvw"], *[weights["t", v] for v in "xy"]])
    assert model.classes == ["high", "low", "mid"] and np.allclose(p.sum(axis=1), 1)
    assert np.abs(x.T @ (p - y) + w).max() < 1e-2 and np.abs((p - y).sum(axis=0)).max() < 1e-2
    assert (got.prediction == np.array(model.classes)[p.argmax(axis=1)]).all()
    loss = quality.class_log_loss(model.predict(rows), [], "k", model.classes).first()[0]
    assert loss == pytest.approx(-np.log((p * y).sum(axis=1)).mean()) and loss < 0.5


def test_new_missing_and_clashing_values(spark):
    frame = table()
    model = tabular.fit(rows_of(spark, frame), ["a", "b"], ["s", "t"], "y", True)
    same = spark.createDataFrame(
        [(1, None, -1e4, None, "x", "kept"), (2, float("nan"), -1e4, model.modes["s"], "x", "kept"),
         (3, model.medians["a"], -1e4, "never seen", "x", "kept")], "row_id long, a double, b double, s string, t string, value string")
    got = {r.row_id: r for r in model.predict(same).collect()}
    weight = {(r.term, r.value): r.coef[0] for r in model.weights.collect()}
    assert got[1].prediction == pytest.approx(got[2].prediction, abs=1e-12) and got[1].value == "kept"
    assert got[3].prediction == pytest.approx(got[1].prediction - weight["s", model.modes["s"]], abs=1e-9)
    assert model.predict(same.where("false")).count() == 0


def test_equally_frequent_categories_fill_with_the_smallest(spark):
    rows = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0)], "s string, y double")
    assert tabular.prepare(rows, [], ["s"])[0].modes == {"s": "a"}


def test_many_categories_are_a_table(spark):
    rows = spark.range(4000).select("id", F.concat(F.lit("c"), F.col("id") % 1500).alias("s"), (F.col("id") % 1500).cast("double").alias("y"))
    model = tabular.fit(rows, [], ["s"], "y", True)
    out = model.predict(rows)
    assert model.weights.count() == 1500 and quality.regression_metrics(out, [], "y", "prediction").first()["r2"] > 0.8


def test_faulty_training_tables_are_refused(spark):
    empty = "a double, s string, y double"
    with pytest.raises(ValueError, match="no target"):
        tabular.fit(spark.createDataFrame([(1.0, "u", None)], empty), ["a"], ["s"], "y")
    with pytest.raises(ValueError, match="no target"):
        tabular.fit(spark.createDataFrame([], empty), ["a"], ["s"], "y")
    with pytest.raises(ValueError, match="without any value"):
        tabular.fit(spark.createDataFrame([(None, "u", 1.0)], empty), ["a"], ["s"], "y")
    with pytest.raises(ValueError, match="two classes"):
        tabular.fit(spark.createDataFrame([(1.0, "u", 1.0)], empty), ["a"], ["s"], "y")
    with pytest.raises(Exception, match="infinite"):
        tabular.fit(spark.createDataFrame([(float("inf"), "u", 1.0)], empty), ["a"], ["s"], "y", True)
    scored = spark.createDataFrame([("z", [0.5, 0.5])], "k string, probabilities array<double>")
    with pytest.raises(Exception, match="unknown class z"):
        quality.class_log_loss(scored, [], "k", ["a", "b"]).collect()
