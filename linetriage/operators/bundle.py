"""Fitted models as a folder that can be checked and loaded again: one component per segment, digests, routing.

Everything goes through Spark's readers and writers, so the folder may be on any store the cluster reaches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.functions.columns import finite
from linetriage.operators import choose, models
from linetriage.session import cut_lineage

SCHEMA = "inspection-bundle-1"
KINDS = ("linear", "constant", "pipeline", "kernel")


def file_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of every file of a bundle's components, by its path below them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/components")
    name = F.regexp_extract("path", "/components/(.*)$", 1)
    return {r["name"]: r["sha"] for r in files.select(name.alias("name"), F.sha2("content", 256).alias("sha")).collect()}


def _write_text(spark: SparkSession, path: str, content: dict) -> None:
    text = json.dumps(content, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _read_text(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} does not hold one document")
    return json.loads(rows[0][0])


def save(scorers: Mapping[str, models.Scorer], features: Sequence[str], path: str, spark: SparkSession, facts: Mapping | None = None) -> dict:
    """Write one component per segment and the manifest with the digests of all files; returns the manifest.

    ``scorers`` are the results of the candidates in ``models``. ``facts`` (seed, routing, data digests) are kept as
    given. An existing folder is an error.
    """
    segments = sorted(scorers)
    for i, segment in enumerate(segments):
        stored = scorers[segment].stored
        folder = f"{path}/components/{i}"
        _write_text(spark, f"{folder}/component", {
            "segment": segment, "kind": stored.kind, "features": list(features), "parameters": stored.parameters})
        if stored.model is not None:
            stored.model.write().save(f"{folder}/model")
    manifest = {"schema": SCHEMA, "features": list(features), "segments": segments, "facts": dict(facts or {}),
                "files": file_digests(spark, path)}
    _write_text(spark, f"{path}/bundle", manifest)
    return manifest


@dataclass
class Bundle:
    manifest: dict
    scorers: dict[str, models.Scorer]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Score every row by the component of its segment. A row of another segment, or a score that is none, is an error."""
        known = F.col("segment").isin(list(self.scorers))
        parts = [scorer(rows.where(F.col("segment") == s)) for s, scorer in self.scorers.items()]
        lost = rows.where(~F.coalesce(known, F.lit(False))).withColumn(
            "score", F.raise_error(F.concat(F.lit("no component for segment "), F.coalesce("segment", F.lit("null")))).cast("double"))
        out = reduce(DataFrame.unionByName, [*parts, lost])
        good = F.coalesce(finite(F.col("score")) & F.col("score").between(0.0, 1.0), F.lit(False))
        return out.withColumn("score", F.when(good, F.col("score")).otherwise(F.raise_error(F.lit("no score between 0 and 1")).cast("double")))


def load(spark: SparkSession, path: str, features: Sequence[str]) -> Bundle:
    """Read a bundle back; a changed, missing or additional file, or other features, schema or segments are refused."""
    manifest = _read_text(spark, f"{path}/bundle")
    if manifest.get("schema") != SCHEMA:
        raise ValueError("unsupported bundle")
    if manifest["features"] != list(features):
        raise ValueError("the bundle was made for other features")
    found = file_digests(spark, path)
    wrong = sorted(n for n in {*found, *manifest["files"]} if found.get(n) != manifest["files"].get(n))
    if wrong:
        raise ValueError(f"files of the bundle differ from its manifest: {wrong}")
    scorers = {}
    for i, segment in enumerate(manifest["segments"]):
        folder = f"{path}/components/{i}"
        part = _read_text(spark, f"{folder}/component")
        if part["segment"] != segment or part["features"] != manifest["features"] or part["kind"] not in KINDS:
            raise ValueError(f"component {i} does not match the manifest")
        model = PipelineModel.load(f"{folder}/model") if part["kind"] in ("pipeline", "kernel") else None
        scorers[segment] = models.restored(models.Stored(part["kind"], part["parameters"], model), features)
    return Bundle(manifest, scorers)


def final_fit(
    rows: DataFrame, features: Sequence[str], candidates: Mapping[str, models.Candidate], folds: Sequence[int], reference: str,
    seed: int, route: str = "nested_guarded", routed: Sequence[str] | None = None,
) -> tuple[dict[str, models.Scorer], dict[str, str], DataFrame]:
    """Choose per segment on the folds of all rows, then fit the choice on all rows of the segment.

    Segments outside of ``routed`` (default: all are routed) keep the reference. Returns the scorers, the winners and
    the metrics that the choice rests on.
    """
    scored = cut_lineage(models.oof_scores(rows, features, {n: models.per_segment(c, _segments(rows)) for n, c in candidates.items()}, folds, seed))
    metrics = cut_lineage(models.inner_metrics(scored, ["segment"]))
    chosen = choose.routes(metrics, ["segment"], reference, list(candidates)).where(F.col("route") == route)
    winners = {r["segment"]: r["winner"] for r in chosen.collect()}
    if routed is not None:
        winners = {s: w if s in routed else reference for s, w in winners.items()}
    return models.fit_segments(rows, features, {s: candidates[w] for s, w in winners.items()}, seed), winners, metrics


def _segments(rows: DataFrame) -> list[str]:
    return sorted(r[0] for r in rows.select("segment").distinct().collect())


def parity(first: DataFrame, second: DataFrame, most: float = 1e-12) -> float:
    """Largest difference of two scorings of the same rows; more than ``most``, or a row in one only, is an error."""
    from linetriage.operators import drift

    found = drift.parity(first, second, ["segment", "row_id"], "score").first()
    error = found["max_abs_error"]
    if found["only_in_first"] or found["only_in_second"] or error is None or not math.isfinite(error) or error > most:
        raise ValueError(f"the stored model scores otherwise: {found.asDict()}")
    return error
