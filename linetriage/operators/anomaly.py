"""Isolation forest: small trees grown on hashed samples inside Spark groups, scored by Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from linetriage.functions.columns import hash_number, hash_text
from linetriage.functions.sizing import small_table

SAMPLE = 256
EULER = 0.5772156649015329
NODE_SCHEMA = "segment string, fold int, tree int, node int, feature int, cut double, right int, depth double"


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, source: np.random.Generator) -> list[tuple[int, float, int, float]]:
    """Tree in preorder: (feature or -1, cut, position of the right child, path length at a leaf)."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple[int, float, int, float]] = []

    def split(rows: np.ndarray, depth: int) -> None:
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        open_features = np.flatnonzero(high > low) if len(rows) > 1 else np.array([], dtype=int)
        if depth >= limit or not len(open_features):
            nodes.append((-1, 0.0, 0, depth + expected_path(len(rows))))
            return
        feature = int(source.choice(open_features))
        cut = float(source.uniform(low[feature], high[feature]))
        at = len(nodes)
        nodes.append((feature, cut, 0, 0.0))
        left = rows[:, feature] <= cut
        split(rows[left], depth + 1)
        nodes[at] = (feature, cut, len(nodes), 0.0)
        split(rows[~left], depth + 1)

    split(x, 0)
    return nodes


def tree_samples(df: DataFrame, trees: int, seed: int) -> DataFrame:
    """At most 256 rows for each (segment, fold, tree), by hash.

    Each row enters only as many trees as it takes to offer every tree about twice its
    sample, so the sample table has about trees * 512 rows per segment and fold at any scale.
    """
    sizes = df.groupBy("segment", "fold").agg(F.count(F.lit(1)).alias("_n"))
    offers = F.lit(2.0 * SAMPLE * trees) / F.col("_n")
    text = hash_text(seed, "segment", "fold", "row_id")
    ready = df.join(small_table(sizes), ["segment", "fold"]).withColumns({
        "_u": hash_number(text, 8) / F.lit(2.0**32), "_h": hash_number(text, 8, 9),
    })
    used = ready.where(F.col("_u") < offers)
    slots = F.least(F.lit(trees), F.greatest(F.lit(1), F.ceil(offers))).cast("int")
    spread = used.withColumn("_j", F.explode(F.sequence(F.lit(0), slots - 1))).withColumn(
        "tree", F.pmod(F.col("_h") + F.col("_j"), F.lit(trees)).cast("int")
    )
    order = Window.partitionBy("segment", "fold", "tree").orderBy(hash_text(seed, "tree", "row_id"), "row_id")
    picked = spread.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE)
    return picked.drop("_n", "_u", "_h", "_j", "_r")


def grow_trees(samples: DataFrame, features: Sequence[str], seed: int) -> DataFrame:
    columns = list(features)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        segment, fold, tree = rows["segment"].iloc[0], int(rows["fold"].iloc[0]), int(rows["tree"].iloc[0])
        ordered = rows.sort_values("row_id")
        source = np.random.default_rng([seed, tree, fold + 1, *segment.encode()])
        nodes = _grow(ordered[columns].to_numpy(dtype=float), source)
        return pd.DataFrame([(segment, fold, tree, i, *node) for i, node in enumerate(nodes)], columns=[
            "segment", "fold", "tree", "node", "feature", "cut", "right", "depth"])

    return samples.select("segment", "fold", "tree", "row_id", *columns).groupBy("segment", "fold", "tree").applyInPandas(
        grow, NODE_SCHEMA
    )


def path_scores(df: DataFrame, trees: DataFrame, features: Sequence[str], samples: DataFrame) -> DataFrame:
    """Anomaly score 2 ^ (-mean path / expected path) with the trees of the row's (segment, fold).

    A tree has at most 511 nodes, so the table sent to the tasks is bounded by trees x segments x folds.
    """
    forest: dict[tuple[str, int], list[tuple[np.ndarray, ...]]] = {}
    nodes = trees.toPandas()
    for (segment, fold, _), part in nodes.groupby(["segment", "fold", "tree"], sort=True):
        part = part.sort_values("node")
        forest.setdefault((segment, int(fold)), []).append(
            tuple(part[c].to_numpy() for c in ("feature", "cut", "right", "depth")))
    sizes = {
        (r["segment"], int(r["fold"])): r["n"] for r in samples.groupBy("segment", "fold", "tree").agg(
            F.count(F.lit(1)).alias("c")).groupBy("segment", "fold").agg(F.max("c").alias("n")).collect()
    }
    shared = df.sparkSession.sparkContext.broadcast((forest, sizes))

    @F.pandas_udf("double")
    def score(segment: pd.Series, fold: pd.Series, x: pd.Series) -> pd.Series:
        all_trees, all_sizes = shared.value
        out = np.full(len(x), np.nan)
        keys = list(zip(segment, fold))
        values = np.vstack(x.to_numpy()) if len(x) else np.empty((0, 0))
        for key in set(keys):
            rows = np.flatnonzero([k == key for k in keys])
            lengths = np.zeros(len(rows))
            for feature, cut, right, depth in all_trees[key]:
                at = np.zeros(len(rows), dtype=int)
                inner = feature[at] >= 0
                while inner.any():
                    moving = np.flatnonzero(inner)
                    node = at[moving]
                    left = values[rows[moving], feature[node]] <= cut[node]
                    at[moving] = np.where(left, node + 1, right[node])
                    inner = feature[at] >= 0
                lengths += depth[at]
            mean = lengths / len(all_trees[key])
            out[rows] = np.power(2.0, -mean / max(expected_path(all_sizes[key]), 1e-12))
        return pd.Series(out)

    values = F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn("score", score("segment", "fold", values))


def isolation_oof(events: DataFrame, features: Sequence[str], folds: Sequence[int], trees: int = 300, seed: int = 0) -> DataFrame:
    """Out-of-fold anomaly scores: for each fold, trees grown on the negative events of the other folds."""
    others = events.where(F.col("label") == 0).withColumn("_to", F.explode(F.array(*[F.lit(int(k)) for k in folds])))
    fitting = others.where(F.col("_to") != F.col("fold")).drop("fold").withColumnRenamed("_to", "fold")
    samples = tree_samples(fitting.select("segment", "fold", "row_id", *features), trees, seed).persist()
    out = path_scores(events, grow_trees(samples, features, seed), features, samples)
    samples.unpersist()
    return out
