import pytest
from pyspark.sql import functions as F

from linetriage.operators import derive, evidence, groups, quality, queue as q, rules

SCORES = "segment string, row_id long, score double, ood_feature_count int"


def forty(spark):
    rows = [("left" if i < 19 else "right", i, 0.99 - i * 0.98 / 39, 3 if i == 0 else 0) for i in range(40)]
    return spark.createDataFrame(rows, SCORES)


def test_queue_of_two_lines(spark):
    scored = forty(spark)
    queue = q.build_queue(scored, ["right"]).cache()
    high = {r.segment: r["count"] for r in queue.where("priority = 'HIGH'").groupBy("segment").count().collect()}
    assert high == {"left": 2, "right": 3}
    actions = {r.row_id: r.action for r in queue.collect()}
    assert actions[0] == q.ACTION_OUT_OF_RANGE and actions[1] == q.ACTION_LABEL and actions[39] == q.ACTION_UNVALIDATED
    q.any_fault(q.queue_faults(queue, scored, ["right"]))


TAMPERED = {
    "duplicate_key": ("row_id", "if(row_id = 5, 6L, row_id)"),
    "action": ("action", "if(row_id = 3, 'usual_inspection_ood', action)"),
    "tier": ("priority", "if(row_id = 18, 'HIGH', priority)"),
    "score": ("risk_score", "if(row_id = 8, double('nan'), risk_score)"),
    "score_order": ("risk_score", "if(row_id = 30, 0.9D, risk_score)"),
    "global_rank_repeated": ("global_rank", "if(row_id = 4, 1L, global_rank)"),
    "segment_rank_range": ("segment_rank", "if(row_id = 4, 99L, segment_rank)"),
    "ood_flag": ("ood_flag", "if(row_id = 0, false, ood_flag)"),
}


@pytest.mark.parametrize("rule", TAMPERED)
def test_tampered_queue_is_found(spark, rule):
    scored = forty(spark)
    queue = q.build_queue(scored, ["right"])
    column, expression = TAMPERED[rule]
    changed = queue.withColumn(column, F.expr(expression))
    faults = {r.rule for r in q.queue_faults(changed, scored, ["right"]).where("failed_rows > 0").collect()}
    assert rule in faults


def test_missing_rows_are_found(spark):
    scored = forty(spark)
    queue = q.build_queue(scored, ["right"])
    got = {r.rule: r.failed_rows for r in q.queue_faults(queue, scored.where("row_id > 0"), ["right"]).collect()}
    assert got["not_in_source"] == 1 and got["not_in_queue"] == 0


def test_pages(spark):
    queue = q.build_queue(forty(spark), ["right"])
    assert [r.global_rank for r in q.page(queue, 5, 3).orderBy("global_rank").collect()] == [6, 7, 8]
    assert {r.segment for r in q.page(queue, 0, 100, "right").collect()} == {"right"}
    for bad in ((-1, 5), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            q.page(queue, *bad)


@pytest.mark.parametrize("segment, score, flag, action, reasons", [
    ("left", 0.5, False, q.ACTION_LABEL, set()),
    ("left", 0.5, True, q.ACTION_OUT_OF_RANGE, {"out_of_training_range"}),
    ("right", 0.5, True, q.ACTION_UNVALIDATED, {"out_of_training_range", "unvalidated_machine"}),
    ("left", 1.5, False, q.ACTION_INPUT_ERROR, {"invalid_or_missing_prediction"}),
    ("left", float("nan"), False, q.ACTION_INPUT_ERROR, {"invalid_or_missing_prediction"}),
    ("left", None, False, q.ACTION_INPUT_ERROR, {"invalid_or_missing_prediction"}),
    ("new", 0.5, False, q.ACTION_INPUT_ERROR, {"invalid_or_missing_prediction", "unvalidated_machine"}),
])
def test_actions_and_reasons(spark, segment, score, flag, action, reasons):
    row = spark.createDataFrame([(segment, 1, score, flag)], "segment string, row_id long, risk_score double, ood_flag boolean")
    r = q.decide(row, ["left"], ["left", "right"]).first()
    assert r.action == action and reasons <= set(r.fallback_reasons)
    assert r.fallback_reasons == sorted(set(r.fallback_reasons))
    if action == q.ACTION_INPUT_ERROR:
        assert r.research_score is None and r.prediction_status == "not_produced"


def test_unhealthy_model_gives_no_score(spark):
    row = spark.createDataFrame([("left", 1, 0.5, False)], "segment string, row_id long, risk_score double, ood_flag boolean")
    r = q.decide(row, ["left"], ["left"], healthy=False).first()
    assert r.research_score is None and "model_unavailable_or_unverified" in r.fallback_reasons


def oof(spark, change=None):
    rows = [(s, i, i % 2, i % 3, m, 0.1 + i / 20) for s in ("a", "b") for i in range(6) for m in ("x", "y")]
    df = spark.createDataFrame(rows, "segment string, row_id long, label int, fold int, model string, score double").withColumn("seed", F.lit(1))
    hit = (F.col("segment") == "a") & (F.col("row_id") == 2) & (F.col("model") == "x")
    return df if change is None else change(df, hit)


EXPECTED = ["segment", "row_id", "label", "fold"]


@pytest.mark.parametrize("rule, change", [
    (None, None),
    ("identity_differs", lambda d, h: d.withColumn("label", F.when(h, 1 - F.col("label")).otherwise(F.col("label")))),
    ("identity_differs", lambda d, h: d.withColumn("fold", F.when(h, 9).otherwise(F.col("fold")))),
    ("score_range", lambda d, h: d.withColumn("score", F.when(h, float("nan")).otherwise(F.col("score")))),
    ("score_range", lambda d, h: d.withColumn("score", F.when(h, 1.1).otherwise(F.col("score")))),
    ("duplicate_row", lambda d, h: d.unionByName(d.where(h))),
    ("incomplete_pairs", lambda d, h: d.where(~h)),
    ("unknown_pair", lambda d, h: d.withColumn("model", F.when(h, "z").otherwise(F.col("model")))),
])
def test_tampered_scores_are_found(spark, rule, change):
    expected = oof(spark).select(*EXPECTED).distinct()
    got = {r.rule for r in rules.oof_faults(oof(spark, change), expected, ["x", "y"], [1]).where("failed_rows > 0").collect()}
    assert (rule in got) if rule else not got


def batch(spark, rows, schema="segment string, row_id long, f double"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("row, rule", [
    (("zz", 2, 1.0), "unknown_segment"), (("a", -1, 1.0), "id_range"), (("a", 2, float("inf")), "not_finite"),
    (("a", 1, 1.0), "duplicate_key"), (("a", 2, None), "not_finite"), ((None, 2, 1.0), "null_key"),
])
def test_scoring_batch_contract(spark, row, rule):
    got = rules.scoring_batch(batch(spark, [("a", 1, 0.0), row]), ["f"], ["a", "b"])
    assert rule in {r.rule for r in got.where("failed_rows > 0").collect()}


def test_scoring_batch_schema(spark):
    with pytest.raises(ValueError, match="not allowed"):
        rules.scoring_batch(batch(spark, [("a", 1, 0.0, 1)], "segment string, row_id long, f double, label int"), ["f"], ["a"])
    with pytest.raises(ValueError, match="numeric"):
        rules.scoring_batch(batch(spark, [("a", 1, "0.0")], "segment string, row_id long, f string"), ["f"], ["a"])
    with pytest.raises(ValueError, match="different feature"):
        rules.require_same_features(batch(spark, [("a", 1, 0.0)]), batch(spark, [("a", 1)], "segment string, row_id long"))
    assert rules.scoring_batch(batch(spark, []), ["f"], ["a"]).where("failed_rows > 0").count() == 0


def test_linear_score_and_overflow(spark):
    weights = spark.createDataFrame(
        [("a", "f", 0.0, 1.0, 1.0), ("a", None, None, None, 0.0)], "segment string, feature string, mean double, scale double, coef double")
    assert derive.linear_score(batch(spark, [("a", 1, 0.0)]), weights, ["f"]).first().score == 0.5
    assert derive.linear_score(batch(spark, [("a", 1, -900.0)]), weights, ["f"]).first().score == 0.0
    with pytest.raises(Exception, match="no finite model output"):
        derive.linear_score(batch(spark, [("a", 1, float("inf"))]), weights, ["f"]).collect()


def test_point_in_time_and_zone(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01T00:00:10Z", "2024-01-01T00:00:05Z", "2024-01-01T00:00:09Z"),
         (2, "2024-01-01T00:00:10Z", "2024-01-01T00:00:05Z", "2024-01-01T09:00:11+09:00"),
         (3, "2024-01-01T00:00:10Z", "2024-01-01T00:00:11Z", "2024-01-01T00:00:09Z")],
        "id int, cutoff string, ended string, arrived string")
    parsed = rows.select("id", *[rules.with_zone(F.col(c)).alias(c) for c in ("cutoff", "ended", "arrived")])
    out = rules.available_in_time(parsed.withColumn("available", F.create_map(F.lit("f"), "arrived")), "cutoff", "ended", "available")
    assert {r.id: r.in_time for r in out.collect()} == {1: True, 2: False, 3: False}
    with pytest.raises(Exception, match="time zone required"):
        spark.range(1).select(rules.with_zone(F.lit("2024-01-01T00:00:00"))).collect()


def test_ledger_gaps_and_strict(spark):
    seen = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], "seed int, candidate string")
    got = {(r.seed, r.candidate, r.fault) for r in rules.ledger_gaps(seen, {"seed": [1, 2], "candidate": ["a"]}).collect()}
    assert got == {(2, "a", "missing"), (2, "c", "unexpected"), (1, "a", "unexpected")}


def test_evidence_view(spark):
    schema = ("item string, status string, scope_hash string, reviewer string, checked_micros long, version long, "
              "evidence_sha256 string, current_sha256 string")
    records = spark.createDataFrame([
        ("raw_units", "confirmed", "s", "r", 1, 1, "h", "h"), ("target_unit", "confirmed", "s", "r", 1, 2, "h", "changed"),
        ("label_semantics", "confirmed", "other", "r", 1, 3, "h", "h"), ("raw_units", "mismatch", "s", "r", 2, 4, "h", "h"),
    ], schema)
    got = {r.item: r.status for r in evidence.current_view(records, q.CONTRACT_ITEMS, "s").collect()}
    assert got["raw_units"] == "mismatch" and got["target_unit"] == "mismatch" and got["label_semantics"] == "unconfirmed"
    assert len(got) == 8
    links = {r.version: r.previous_version for r in evidence.linked_history(records).collect()}
    assert links[4] == 1 and links[1] is None


def test_metric_replay_finds_a_changed_cell(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 0.5)], "model string, ap double, auc double")
    assert rules.metric_faults(a, a, ["model"]).count() == 0
    b = a.withColumn("ap", F.when(F.col("model") == "y", 2.1).otherwise(F.col("ap")))
    (r,) = rules.metric_faults(a, b, ["model"]).collect()
    assert (r.model, r.metric, r.saved, r.again) == ("y", "ap", 2.0, 2.1)


@pytest.mark.parametrize("score", [None, float("nan"), 1.5, -0.1])
def test_queue_refuses_invalid_scores(spark, score):
    rows = forty(spark).unionByName(spark.createDataFrame([("left", 99, score, 0)], SCORES))
    with pytest.raises(Exception, match="risk scores must be finite|cannot be ordered"):
        q.build_queue(rows, ["right"]).collect()


def test_nulls_in_a_queue_are_faults(spark):
    scored = spark.createDataFrame(
        [("a", i, i / 100, 0) for i in range(20)], "segment string, row_id long, score double, ood_feature_count int")
    good = q.build_queue(scored, [])
    assert {r.failed_rows for r in q.queue_faults(good, scored, []).collect()} == {0}
    for column, rule in (("segment_rank", "segment_rank_range"), ("ood_feature_count", "ood_flag"), ("ood_flag", "ood_flag"),
                         ("global_rank", "global_rank_range"), ("risk_score", "score")):
        bad = good.withColumn(column, F.when(F.col("row_id") != 7, F.col(column)))
        found = {r.rule: r.failed_rows for r in q.queue_faults(bad, scored, []).collect()}
        assert found["null_value"] == 1 and found[rule] == 1, column


def test_folds_of_a_cohort_are_counted_not_spanned(spark):
    rows = spark.createDataFrame(
        [("a", "g", 0, 1), ("a", "h", 1, 0), ("a", "i", 4, 0), ("a", "i", None, 0)],
        "segment string, group_id string, fold int, label int")
    assert rules.cohort(rows).first().folds == 3


def test_a_null_beside_a_value_differs(spark):
    rows = spark.createDataFrame([("g", None), ("g", 3.0), ("h", None), ("h", None), ("i", 1.0), ("i", 1.0)], "group_id string, x double")
    assert rules.group_integrity(rows, ["x"]).first().failed_rows == 1


def test_missing_scores_are_errors(spark):
    for score in (None, float("nan")):
        rows = spark.createDataFrame([("m", "g", 0.5, 1), ("m", "g", score, 0)], "model string, group_id string, score double, label int")
        with pytest.raises(Exception, match="missing or not finite"):
            rules.score_spread(rows, ["model"]).collect()
        with pytest.raises(Exception, match="missing or not finite"):
            quality.reliability(rows, ["model"]).collect()


def test_collapse_needs_equal_measurements(spark):
    rows = spark.createDataFrame([("s", "g", 1, 0, None), ("s", "g", 2, 1, 3.0)], "segment string, group_id string, row_id int, label int, x double")
    with pytest.raises(Exception, match="different x"):
        groups.collapse_events(rows, ["x"]).collect()


def test_a_null_beside_a_value_is_a_fault(spark):
    from linetriage.operators import derive, drift, joins

    a = spark.createDataFrame([(1, 0.5, 1, "g"), (2, 0.5, 0, "g"), (3, None, None, "h")], "row_id int, x double, label int, group_id string")
    b = spark.createDataFrame([(1, 0.5, 1, "k"), (2, None, None, None), (3, None, None, "m")], "row_id int, x double, label int, group_id string")
    found = drift.parity(a, b, ["row_id"], "x").first()
    assert (found.keys, found.only_in_first, found.only_in_second, found.max_abs_error) == (3, 1, 0, 0.0)
    report = joins.left_report(a, b.withColumnRenamed("x", "y"), ["row_id"], "x", "y").first()
    assert (report.rows, report.unmatched, report.differing) == (3, 0, 1)
    faults = {r.rule: r.failed_rows for r in joins.group_bijection(a, b, ["row_id"]).collect()}
    assert faults["changed_labels"] == 1 and faults["split_groups"] == 1 and faults["unmatched_rows"] == 0
    with pytest.raises(Exception, match="needs a label"):
        derive.balanced_weights(a.withColumn("segment", derive.F.lit("s")), ["segment"]).collect()
