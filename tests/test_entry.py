"""The registered queries: names, coverage, stable results, and plans."""

import os
import re

import pytest

import __spark_entry__ as entry_point
from linetriage.plans.registry import load_all
from linetriage.operators import budget
from linetriage.plans import views

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")

# The operator ids of the blueprint that a query must cover (tests cover the rest).
WANTED = (
    [f"S{i}" for i in range(1, 14)] + [f"Q{i}" for i in range(1, 23)]
    + [f"P{i}" for i in range(1, 16)] + [f"J{i}" for i in range(1, 10)] + [f"A{i}" for i in range(1, 40)]
    + [f"W{i}" for i in range(1, 10)] + [f"T{i}" for i in range(1, 5)] + [f"U{i}" for i in range(1, 6)]
    + [f"G{i}" for i in range(1, 12)] + [f"M{i}" for i in range(1, 16)]
)


def test_every_operator_has_a_query():
    covered = {c for e in load_all().values() for c in e.covers}
    assert [w for w in WANTED if w not in covered] == []


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@needs_data
def test_entry_returns_the_queue(spark):
    rows = entry_point.entry(spark)
    assert rows.columns[:3] == ["segment", "row_id", "risk_score"] and rows.count() == 6000


@needs_data
@pytest.mark.parametrize("name", [
    "queue", "budget_global", "frac_rank", "comparison_grid", "tie_bounds", "ks_drift", "kfold", "boot_ap", "f2_threshold"])
def test_results_do_not_depend_on_partition_count(spark, partitions, name):
    run = entry_point.queries()[name]
    first = partitions(1, lambda: sorted(map(str, run(spark, SF).collect())))
    other = partitions(37, lambda: sorted(map(str, run(spark, SF).collect())))
    assert first == other


@needs_data
def test_budget_needs_no_shuffle_of_rows(spark):
    rows = views.observations(spark, SF)
    plan = budget.select(rows.select("segment", "row_id", "score"), 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan


@needs_data
def test_page_filter_reaches_the_scan(spark, tmp_path):
    from linetriage.operators import queue as q

    path = str(tmp_path / "queue")
    entry_point.entry(spark).write.parquet(path)
    plan = q.page(spark.read.parquet(path), 100, 50).select("row_id")._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[[^\]]*\]", plan).group(0)
    assert "GreaterThanOrEqual(global_rank,101)" in pushed and "LessThanOrEqual(global_rank,150)" in pushed
    assert "risk_score" not in re.search(r"ReadSchema: \S+", plan).group(0)
