import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from linetriage.operators import draws, resample

FRACTIONS = [0.1, 0.2, 0.5]


def plain(rows, weights, fraction):
    """Every copy of every row in one list, in order."""
    w = rows.group_id.map(weights).fillna(0).astype(int)
    copies = rows.loc[rows.index.repeat(w)].sort_values(["score", "segment", "row_id"], ascending=[False, True, True])
    k = max(1, int(np.ceil(fraction * len(copies))))
    steps = copies.groupby("score", sort=False).label.agg(["size", "sum"])
    caught, upto = steps["sum"].cumsum(), steps["size"].cumsum()
    total = steps["sum"].sum()
    ap = (steps["sum"] * caught / upto).sum() / total if total else None
    return len(copies), total, k, copies.label.head(k).sum(), ap


@pytest.fixture(scope="module")
def rows():
    """A third of the rows has one score and one group; the other scores tie in tens."""
    source = np.random.default_rng(8)
    n = 900
    frame = pd.DataFrame({"row_id": np.arange(n), "segment": source.choice(["a", "b"], n), "label": (source.random(n) < 0.2).astype(int)})
    frame["score"] = np.where(frame.row_id % 3 == 0, 0.55, source.integers(0, 60, n) / 60)
    frame["group_id"] = np.where(frame.row_id % 3 == 1, "hot", [f"g{i // 2}" for i in frame.row_id])
    return frame


@pytest.mark.parametrize("scopes", [("all",), ("all", "segment")])
def test_draws_equal_sorted_copies(spark, rows, scopes, partitions):
    df = spark.createDataFrame(rows)
    weights = resample.multinomial_weights(df, 70, 3)
    drawn = weights.toPandas()
    for count in (3, 20):
        got = partitions(count, lambda: resample.draw_metrics(df, weights, [], FRACTIONS, scopes=scopes).toPandas())
        assert len(got) == 70 * 3 * (1 if len(scopes) == 1 else 3)
        for r in got.itertuples():
            if r.draw % 9 and r.draw < 62:
                continue
            part = rows if r.scope == "all" else rows[rows.segment == r.scope]
            own = drawn[drawn.draw == r.draw].set_index("group_id").w
            size, total, k, found, ap = plain(part, own, r.fraction)
            assert (r.rows, r.positives, r.k, r.found) == (size, total, k, found), (r, found)
            assert r.average_precision == pytest.approx(ap, abs=1e-12)


def test_vector_sums_are_hashed_and_exact(spark):
    rows = spark.range(1000).select((F.col("id") % 300).alias("k"), F.array(*[(F.col("id") * i).cast("double") for i in range(128)]).alias("v"))
    sums = resample._vector_sums(rows, ["k"], "v", 128)
    assert "ObjectHashAggregate" not in sums._jdf.queryExecution().executedPlan().toString()
    got = {r.k: list(r.v) for r in sums.collect()}
    assert len(got) == 300 and all(got[k] == [float(i * sum(range(k, 1000, 300))) for i in range(128)] for k in got)


def test_paired_query_takes_all_draws_like_its_sql(spark, tmp_path):
    """Own rows with many equal values; the query once took 50 draws of the operator's 1,000."""
    duckdb = pytest.importorskip("duckdb")
    n = 60
    source = np.random.default_rng(3)
    pd.DataFrame({
        "event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01"), "user_id": source.integers(0, 60, n) * 10,
        "event_type": source.choice(["a", "b"], n), "value": source.integers(1, 15, n) / 2, "props": "{}",
    }).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = entry_point.queries()["boot_paired"](spark, str(tmp_path)).toPandas()
    assert set(got.requested_repeats) == {resample.DRAWS} == {1000}
    assert (got.valid_repeats + got.invalid_repeats == 1000).all() and len(got) == 2 * 3 * 4
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(entry_point.oracle_sql()["boot_paired"]).df()
    keys = ["seed", "segment", "policy", "metric"]
    both = [x.set_index(keys).sort_index()[sorted(set(got) - set(keys))] for x in (got, want)]
    pd.testing.assert_frame_equal(*both, check_dtype=False, atol=1e-9)


@pytest.mark.parametrize("strata", [[], ["segment"]])
def test_packed_draws_equal_long_ones(spark, rows, strata, monkeypatch):
    monkeypatch.setattr(draws, "RANGE", 100)
    monkeypatch.setattr(draws, "UNIT", 8)
    df, link = spark.createDataFrame(rows), [*strata, "group_id"]
    long = resample.multinomial_weights(df, 21, 5, strata)
    packs = [draws.pack(long, link), resample.multinomial_picks(df, 21, 5, strata), resample.multinomial_picks(df, 21, 5, strata, observed=True)]
    want = long.select(draws.link_key(link).alias("link"), "draw", "w").toPandas().pivot(index="link", columns="draw", values="w").fillna(0)
    for picks, first in zip(packs, (0, 0, -1)):
        table = picks.table.toPandas().set_index("link")
        w = draws.block_weights(draws.planes_of(table.picks.tolist(), picks.count), 0, picks.count)
        assert (picks.first, picks.count) == (first, 21 - first)
        assert first == 0 or (w[:, 0] == 1).all()
        got = pd.DataFrame(w[:, -first:], index=table.index)
        pd.testing.assert_frame_equal(got.reindex(want.index), want, check_names=False, check_dtype=False, check_column_type=False)
        assert got.drop(want.index).to_numpy().sum() == 0


def test_bit_planes_keep_any_weight():
    w = np.array([[0, 0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 255, 256, 65535, 65536, 3, 2, 2**40], [1, 1, 0, 2, 0, 0, 1, 0, 5]])
    binaries = draws.packed(w)
    assert [len(b) for b in binaries] == [2, 82, 6]
    planes = draws.planes_of(binaries, 9)
    assert (draws.block_weights(planes, 0, 9) == w).all() and (draws.block_weights(planes, 8, 1) == w[:, 8:]).all()
