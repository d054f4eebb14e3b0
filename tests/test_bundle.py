"""Stored models: every kind scores alike after loading, and changed folders are refused."""

import pytest
from pyspark.sql import functions as F

from linetriage.operators import bundle, models
from test_models import data

FEATURES = ["a", "b", "c"]


def both(spark):
    rows = spark.createDataFrame(data())
    return rows.unionByName(rows.withColumns({"segment": F.lit("t"), "row_id": F.col("row_id") + 1000, "label": 1 - F.col("label")}))


@pytest.mark.parametrize("candidate, kind", [
    (models.logistic(), "linear"), (models.prior(), "constant"), (models.forest(5, 3), "pipeline"),
    (models.boosted(2, 4), "pipeline"), (models.fourier_svc(1.0, 16), "kernel")])
def test_every_kind_scores_alike_after_loading(spark, tmp_path, candidate, kind):
    rows = both(spark).where("segment = 's'")
    scorer = candidate(rows, FEATURES, 7)
    made = bundle.save({"s": scorer}, FEATURES, f"{tmp_path}/b", spark, {"seed": 7})
    loaded = bundle.load(spark, f"{tmp_path}/b", FEATURES)
    assert loaded.manifest == made and loaded.scorers["s"].stored.kind == kind
    assert bundle.parity(scorer(rows), loaded.predict(rows)) <= 1e-12
    with pytest.raises(Exception, match="EXISTS|exists"):
        bundle.save({"s": scorer}, FEATURES, f"{tmp_path}/b", spark)


def test_rows_without_a_component_and_other_models_are_errors(spark, tmp_path):
    rows = both(spark)
    scorer = models.logistic()(rows.where("segment = 's'"), FEATURES, 1)
    bundle.save({"s": scorer}, FEATURES, f"{tmp_path}/b", spark)
    loaded = bundle.load(spark, f"{tmp_path}/b", FEATURES)
    for segment in (F.lit("t"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="no component for segment"):
            loaded.predict(rows.where("row_id < 3").withColumn("segment", segment)).collect()
    assert loaded.predict(rows.where("false")).count() == 0
    other = models.logistic(5.0)(rows.where("segment = 's'"), FEATURES, 1)
    with pytest.raises(ValueError, match="scores otherwise"):
        bundle.parity(other(rows.where("segment = 's'")), loaded.predict(rows.where("segment = 's'")))


def test_the_final_fit_follows_the_route(spark):
    rows = both(spark).cache()
    candidates = {"prior": models.prior(), "logistic": models.logistic(1.0)}
    scorers, winners, metrics = bundle.final_fit(rows, FEATURES, candidates, range(3), "prior", 1, routed=["s"])
    assert winners == {"s": "logistic", "t": "prior"} and metrics.count() == 4
    assert scorers["s"].stored.kind == "linear" and scorers["t"].stored.parameters["rate"] == pytest.approx(
        rows.where("segment = 't'").agg(F.avg("label")).first()[0])
