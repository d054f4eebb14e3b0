from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linetriage.operators import models, runs
from linetriage.session import cut_lineage

NAMES = ["reference", "other", "flat"]


@pytest.fixture(scope="module")
def made(spark):
    """A run without fits: scores with many ties, one candidate that gives the same score to all rows."""
    source = np.random.default_rng(4)
    rows = pd.DataFrame({"row_id": np.arange(240), "segment": np.where(np.arange(240) % 2, "a", "b")})
    rows["group_id"] = [f"g{i // 3}" for i in range(240)]
    rows["fold"] = (np.arange(240) // 3 % 3).astype("int32")
    rows["label"] = ((source.random(240) < 0.3) | (rows.row_id < 24)).astype("int32")
    inner = pd.DataFrame([(k, g, (i + k) % 2) for k in range(3) for i, g in enumerate(rows.group_id.unique())
                          if i % 3 != k], columns=["outer", "group_id", "inner_fold"]).astype({"outer": "int32", "inner_fold": "int32"})
    scored = pd.concat([rows.assign(candidate=n, score=0.5 if n == "flat" else np.round(
        np.clip(0.3 * rows.label + source.random(240), 0, 1), 1)) for n in NAMES])
    frame = spark.createDataFrame(scored)
    placed = frame.join(spark.createDataFrame(inner), "group_id").where("outer <> fold").drop("fold")
    outer = frame.withColumn("outer", F.col("fold"))
    ledger = [(n, k, s, o, int(((rows.fold != k) & (rows.segment == s)).sum()), int(rows[(rows.fold != k) & (rows.segment == s)].label.sum()))
              for n in NAMES for k in range(3) for s in "ab" for o in [None]]
    for o in range(3):
        part = rows[rows.fold != o].merge(inner[inner.outer == o], on="group_id")
        for k in range(2):
            rest = part[part.inner_fold != k]
            ledger += [(n, k, None, o, len(rest), int(rest.label.sum())) for n in NAMES]
    run = models.routed_run(cut_lineage(placed), cut_lineage(outer), NAMES, "reference", spark.createDataFrame(
        ledger, "candidate string, fold int, segment string, outer int, training_rows long, training_positives long"))
    run = replace(run, choices=cut_lineage(run.choices), decided=cut_lineage(run.decided))
    return run, spark.createDataFrame(rows), spark.createDataFrame(inner)


def failed(check, run, made):
    found = runs.CHECKS[check](run, made[1], made[2], NAMES).first()
    return found["failed"]


def told(df, column, value, where):
    return df.withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))


def test_a_run_agrees_with_itself_and_after_storage(spark, made, tmp_path):
    run, rows, inner = made
    runs.save_run(run, str(tmp_path / "run"))
    out = {r["check"]: r for r in runs.verify_run(runs.load_run(spark, str(tmp_path / "run")), rows, inner, NAMES).collect()}
    assert set(out) == set(runs.CHECKS) and all(r["failed"] == 0 for r in out.values())
    assert {n: r["compared"] for n, r in out.items()} == {
        "inner_rows": 240 * 2 * 3, "outer_rows": 240 * 3, "metrics": 3 * 2 * 3 * 8, "choices": 3 * 2 * 5, "decisions": 240 * 6, "ledger": 27}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runs.save_run(run, str(tmp_path / "run"))


def test_a_run_without_a_ledger(made):
    run, rows, inner = made
    assert runs.verify_run(replace(run, ledger=None), rows, inner, NAMES).count() == 5


def test_lost_repeated_and_bad_scores_are_found(made):
    run = made[0]
    lost = run.inner_scores.where("NOT (row_id = 7 AND candidate = 'other')")
    assert failed("inner_rows", replace(run, inner_scores=lost), made) == 2  # one for each outer fold that trains on it
    twice = run.outer_scores.unionByName(run.outer_scores.where("row_id < 4 AND candidate = 'flat'"))
    assert failed("outer_rows", replace(run, outer_scores=twice), made) == 4
    for bad in (None, float("nan"), 1.5):
        broken = told(run.outer_scores, "score", F.lit(bad).cast("double"), "row_id = 9 AND candidate = 'flat'")
        assert failed("outer_rows", replace(run, outer_scores=broken), made) == 1
    moved = told(run.outer_scores, "label", 1 - F.col("label"), "row_id = 9 AND candidate = 'flat'")
    assert failed("outer_rows", replace(run, outer_scores=moved), made) == 1
    unknown = told(run.outer_scores, "group_id", F.lit(None).cast("string"), "row_id = 9 AND candidate = 'flat'")
    assert failed("outer_rows", replace(run, outer_scores=unknown), made) == 1


@pytest.mark.parametrize("cell", runs.CELLS)
def test_every_metric_cell_is_recomputed(made, cell):
    run = made[0]
    where = "outer = 1 AND segment = 'a' AND candidate = 'other'"
    by = 1 if cell == "found" else 1e-6
    changed = replace(run, metrics=told(run.metrics, cell, F.col(cell) + by, where))
    # A threshold that is no score has no F1 and no recall either.
    assert failed("metrics", changed, made) == (2 if cell == "f1_threshold" else 1)
    gone = replace(run, metrics=told(run.metrics, cell, F.lit(None).cast(dict(run.metrics.dtypes)[cell]), where))
    assert failed("metrics", gone, made) >= 1


def test_changed_choices_and_decisions_are_found(made):
    run = made[0]
    for route in ("baseline", "nested_recall", "nested_guarded", "nested_f1", "nested_high_recall"):
        other = F.when(F.col("winner") == "other", "flat").otherwise("other")
        assert failed("choices", replace(run, choices=told(run.choices, "winner", other, f"outer = 2 AND route = '{route}'")), made) == 2
    assert failed("choices", replace(run, choices=run.choices.where("outer > 0")), made) == 10
    for column in ("f1_decision", "high_recall_decision"):
        for route in ("nested_f1", "union"):
            flipped = told(run.decided, column, ~F.col(column), f"row_id % 10 = 3 AND route = '{route}'")
            assert failed("decisions", replace(run, decided=flipped), made) == 24
    shifted = told(run.decided, "score", F.col("score") * 0.999, "row_id = 30 AND route = 'baseline'")
    assert failed("decisions", replace(run, decided=shifted), made) == 1


def test_changed_ledgers_are_found(made):
    run = made[0]
    more = told(run.ledger, "training_positives", F.col("training_positives") + 1, "fold = 1 AND candidate = 'flat' AND outer = 0")
    assert failed("ledger", replace(run, ledger=more), made) == 1
    assert failed("ledger", replace(run, ledger=run.ledger.where("NOT (fold = 2 AND outer IS NULL)")), made) == 3
