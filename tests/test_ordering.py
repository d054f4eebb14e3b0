"""Ranks and running totals against pandas, with one value holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linetriage.operators import quantiles
from linetriage.operators.ordering import (
    find_cuts, previous_row, rank_everywhere_and_within, rank_rows, rows_at_rank, running_by_value,
)
from linetriage.operators.windows import average_rank


def hot_rows(n=900, seed=1):
    source = np.random.default_rng(seed)
    score = source.random(n).round(2)
    score[: n // 3] = 0.5
    rows = pd.DataFrame({
        "segment": np.where(source.random(n) < 0.7, "a", "b"), "row_id": source.permutation(n), "score": score,
        "label": (source.random(n) < 0.2).astype(int),
    })
    return rows.sample(frac=1, random_state=2).reset_index(drop=True)


def expected_ranks(rows, scope):
    ordered = rows.sort_values(["score", "segment", "row_id"], ascending=[False, True, True])
    if scope:
        ordered["r"] = ordered.groupby(scope).cumcount() + 1
    else:
        ordered["r"] = np.arange(1, len(ordered) + 1)
    return ordered.set_index("row_id").r.to_dict()


@pytest.mark.parametrize("count", [1, 8, 200])
@pytest.mark.parametrize("scope", [[], ["segment"]])
def test_rank_rows_is_exact_for_any_partitioning(spark, partitions, count, scope):
    rows = hot_rows()
    frame = spark.createDataFrame(rows).repartition(7)
    got = partitions(count, lambda: {r.row_id: r["rank"] for r in rank_rows(frame, scope).collect()})
    assert got == expected_ranks(rows, scope)


def test_a_value_that_fills_buckets_is_cut_by_its_tie_key(spark):
    cuts = find_cuts(spark.createDataFrame(hot_rows()), "score", "row_id")
    assert cuts.heavy and len(cuts.tie_splits) > 1


def test_both_ranks_come_together(spark):
    rows = hot_rows(300)
    got = rank_everywhere_and_within(spark.createDataFrame(rows), "segment").collect()
    assert {r.row_id: r.global_rank for r in got} == expected_ranks(rows, [])
    assert {r.row_id: r.segment_rank for r in got} == expected_ranks(rows, ["segment"])
    sizes = rows.segment.value_counts().to_dict()
    assert all(r.segment_rank_total == sizes[r.segment] for r in got)


def test_running_totals_by_value(spark):
    rows = hot_rows()
    got = running_by_value(
        spark.createDataFrame(rows), ["segment"], "score", {"n": F.lit(1), "pos": F.col("label")}
    ).toPandas()
    for (segment, score), part in got.groupby(["segment", "score"]):
        higher = rows[(rows.segment == segment) & (rows.score > score)]
        own = rows[(rows.segment == segment) & (rows.score == score)]
        r = part.iloc[0]
        assert (r.n, r.pos) == (len(own), own.label.sum())
        assert (r.n_before, r.pos_before) == (len(higher), higher.label.sum())
        assert r.n_total == (rows.segment == segment).sum()


def test_row_at_rank(spark):
    rows = hot_rows()
    want = {v: k for k, v in expected_ranks(rows, []).items()}
    at = rows_at_rank(spark.createDataFrame(rows), [], {"x": F.lit(200), "y": F.col("n")})
    got = {r.rank_name: r.row_id for r in at.collect()}
    assert got == {"x": want[200], "y": want[len(rows)]}


def test_previous_row_crosses_buckets(spark):
    rows = hot_rows()
    got = previous_row(spark.createDataFrame(rows), ["segment"], "score", "row_id", ["row_id"]).toPandas()
    ordered = rows.sort_values(["score", "row_id"])
    ordered["want"] = ordered.groupby("segment").row_id.shift()
    merged = got.merge(ordered[["row_id", "want"]], on="row_id")
    same = (merged.previous_row_id == merged.want) | (merged.previous_row_id.isna() & merged.want.isna())
    assert same.all() and len(merged) == len(rows)


def test_average_rank_treats_ties_alike(spark):
    rows = hot_rows(200)
    got = average_rank(spark.createDataFrame(rows), ["segment"]).toPandas().set_index("row_id").share_rank
    want = rows.groupby("segment").score.rank(method="average") / rows.groupby("segment").score.transform("size")
    assert np.allclose(got.loc[rows.row_id].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("count", [1, 8])
def test_quantiles_interpolate_like_pandas(spark, partitions, count):
    rows = hot_rows(500)
    shares = [0.0, 0.001, 0.1, 0.5, 0.999, 1.0]
    frame = spark.createDataFrame(rows)
    got = partitions(count, lambda: quantiles.quantiles(frame, ["segment"], "score", shares).toPandas())
    for segment, part in got.groupby("segment"):
        want = rows[rows.segment == segment].score.quantile(shares)
        assert np.allclose(part.set_index("share")["quantile"].loc[shares], want)


@pytest.mark.parametrize("score", [None, float("nan")])
def test_a_row_without_a_place_is_an_error_not_a_lost_row(spark, score):
    frame = spark.createDataFrame([("a", 1, 0.5), ("a", 2, score)], "segment string, row_id long, score double")
    with pytest.raises(Exception, match="cannot be ordered"):
        rank_rows(frame, ["segment"]).collect()


def test_both_ranks_of_a_blend_read_stored_pairs(spark):
    from linetriage.plans import join_queries

    files = join_queries.rank_blend(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("events.parquet" in f for f in files)


def test_queue_check_groups_its_keys_once(spark):
    import re

    from linetriage.operators import queue as q

    rows = spark.createDataFrame([("a", 1, 0.5, 0), ("a", 2, 0.4, 0), ("b", 3, 0.3, 3)], "segment string, row_id long, score double, ood_feature_count int")
    built = q.build_queue(rows, [])
    faults = q.queue_faults(built.unionByName(built.where("row_id = 3")), rows.where("row_id <> 1"), [])
    assert len(re.findall(r"Exchange hashpartitioning\(segment#\d+, row_id#", faults._jdf.queryExecution().executedPlan().toString())) == 1
    got = {r["rule"]: r["failed_rows"] for r in faults.collect()}
    assert (got["duplicate_key"], got["not_in_source"], got["not_in_queue"]) == (1, 1, 0)
