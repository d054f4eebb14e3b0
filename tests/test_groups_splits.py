import pytest
from pyspark.sql import functions as F

from linetriage.functions.sizing import attach
from linetriage.operators import groups, rules, splits


def sensor_rows(spark, group_count=40):
    """Two segments, each group twice, label = group parity."""
    rows = [(s, g * 2 + c, float(g), float(g % 7), g % 2) for s in ("left", "right") for g in range(group_count) for c in (0, 1)]
    return spark.createDataFrame(rows, "segment string, row_id long, a double, b double, label int")


def test_groups_are_exact_and_cover_copies(spark):
    rows = groups.with_groups(sensor_rows(spark), ["a", "b"])
    per = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.min("a").alias("x"), F.max("a").alias("y")).collect()
    assert len(per) == 80 and all(r.n == 2 and r.x == r.y for r in per)


def test_zero_and_negative_zero_are_one_group(spark):
    rows = spark.createDataFrame([("s", 1, 0.0, 0), ("s", 2, -0.0, 1)], "segment string, row_id long, a double, label int")
    assert groups.with_groups(rows, ["a"]).select("group_id").distinct().count() == 1


def test_hot_group_takes_the_broadcast_side_and_loses_nothing(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(3000)], "row_id long, k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = attach(rows, table, ["k"], "n")
    assert "Union" in out._jdf.queryExecution().toString()
    assert out.count() == 3000 and out.where("k = 0").select("n").distinct().first().n == rows.where("k = 0").count()


def test_collapse_takes_any_positive_and_refuses_mixed_groups(spark):
    rows = spark.createDataFrame(
        [("s", 1, "g", 1.0, 0), ("s", 2, "g", 1.0, 1), ("s", 3, "h", 2.0, 0), ("s", 4, "h", 2.0, 0)],
        "segment string, row_id long, group_id string, a double, label int")
    assert {r.group_id: r.label for r in groups.collapse_events(rows, ["a"]).collect()} == {"g": 1, "h": 0}
    mixed = rows.withColumn("a", F.when(F.col("row_id") == 2, 9.0).otherwise(F.col("a")))
    with pytest.raises(Exception, match="group with different a"):
        groups.collapse_events(mixed, ["a"]).collect()


def test_oversampling_repeats_positives_only(spark):
    rows = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "row_id long, label int")
    out = groups.oversample(rows, 5)
    assert out.count() == 7 and out.where("label = 1").count() == 5 and out.where("label = 1").select("row_id").distinct().count() == 1


def test_weights_of_groups_have_mean_one(spark):
    rows = groups.row_attributes(sensor_rows(spark), ["a", "b"])
    assert rows.agg(F.avg("group_weight")).first()[0] == pytest.approx(1.0)


def test_manifest_is_valid_balanced_and_independent_of_partitioning(spark, partitions):
    rows = sensor_rows(spark)
    manifest = splits.split_manifest(rows, ["a", "b"], 0.2, 5, 3)
    assert rules.split_membership(manifest, 5).where("failed_rows > 0").count() == 0
    held = manifest.where("partition = 'holdout'")
    assert held.count() == 32 and held.groupBy("segment", "label").count().where("count = 8").count() == 4
    sizes = [r["count"] for r in manifest.where("fold is not null").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2
    again = partitions(3, lambda: splits.split_manifest(rows.orderBy("b", F.desc("row_id")), ["a", "b"], 0.2, 5, 3).collect())
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, manifest.collect()), key=str)


@pytest.mark.parametrize("change, rule", [
    ("if(row_id = 3, 'test', partition)", "partition_name"),
    ("if(row_id = 3, 'holdout', 'development')", "group_in_partitions"),
])
def test_changed_partitions_are_found(spark, change, rule):
    manifest = splits.split_manifest(sensor_rows(spark), ["a", "b"], 0.2, 5, 3).withColumn("partition", F.expr(change))
    faults = rules.split_membership(manifest, 5)
    assert rule in {r.rule for r in faults.where("failed_rows > 0").collect()}
    with pytest.raises(ValueError, match=rule):
        rules.strict(faults)


def test_comparison_counts_repeats_and_nulls_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(splits, "COMPARED", 100)
    first = spark.createDataFrame([(i % 700, None if i % 3 else "x") for i in range(2100)], "row_id long, side string")
    second = first.where("row_id <> 5").unionByName(spark.createDataFrame([(5, "y"), (5, None), (5, "x")], first.schema))
    in_plan = splits.compare_manifests(first, second)
    assert {r.side: r.rows for r in in_plan.collect()} == {"only_in_first": 1, "only_in_second": 1}
    assert {r.side: r.rows for r in splits.compare_manifests(first, first.repartition(5)).collect()} == {"only_in_first": 0, "only_in_second": 0}
    assert "REPARTITION_BY_NUM" in in_plan._jdf.queryExecution().toString()


def test_inner_folds_stay_inside_training(spark):
    table = splits.deal_folds(groups.group_table(sensor_rows(spark), ["a", "b"]), 5, 1)
    inner = splits.inner_folds(table, range(5), 9)
    joined = inner.join(table.select("group_id", F.col("fold").alias("own")), "group_id")
    assert joined.where("outer = own").count() == 0
    per = inner.groupBy("outer", "group_id").count()
    assert per.where("count <> 1").count() == 0 and per.count() == 4 * table.count()
    assert inner.agg(F.max("inner_fold")).first()[0] == 2


def test_too_few_groups_for_inner_folds(spark):
    table = groups.group_table(sensor_rows(spark, 2), ["a", "b"]).withColumn("fold", F.lit(0))
    with pytest.raises(Exception, match="too few groups"):
        splits.inner_folds(table, [1], 9).collect()


def test_time_split_keeps_equal_times_together(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([1, 2, 3, 3, 3, 4])], "row_id long, t int")
    timed = rows.withColumn("ts", F.timestamp_seconds("t"))
    out = {r.row_id for r in splits.time_split(timed, 0.34).where("test").collect()}
    assert out == {2, 3, 4, 5}
    with pytest.raises(ValueError, match="equal times"):
        splits.time_split(rows.withColumn("ts", F.timestamp_seconds(F.lit(5))), 0.5)


def test_group_split_keeps_groups_whole(spark):
    rows = sensor_rows(spark).withColumn("g", F.col("a").cast("long"))
    out = splits.group_split(rows, 0.25, 4, "g")
    assert out.count() == rows.count()
    assert out.groupBy("g").agg(F.count_distinct("test").alias("n")).where("n > 1").count() == 0
    assert out.where("test").select("g").distinct().count() == 10


def test_sample_is_cut_at_a_hash_without_a_sort(spark):
    rows = spark.range(500).withColumnRenamed("id", "row_id")
    few = splits.sample_rows(rows, 37, 5)
    assert few.count() == 37 and {r.row_id for r in few.collect()} < {r.row_id for r in splits.sample_rows(rows.repartition(7), 90, 5).collect()}
    assert splits.sample_rows(rows, 5000, 5).count() == 500 and splits.sample_rows(rows.limit(0), 5, 5).count() == 0
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
