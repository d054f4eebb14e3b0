"""The given tables read as inspection data, once as DataFrames and once as SQL views.

observations  events    segment = event type, one measured value, score and label
oof           events    the same rows scored by two models under two seeds
readings      lineitem  three features with many identical vectors
timed         orders    rows with a time
docs          documents with the labels of some of them
vectors       embeddings, 64 features
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.functions.sizing import spread

MODELS = ("ratio", "mixed")
SEEDS = (1, 2)
FEATURES = ("l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return spread(table(spark, sf, "events"), "event_id").select(
        F.col("event_type").alias("segment"), F.col("event_id").alias("row_id"), "ts", "user_id", "value",
        F.concat(F.col("event_type"), F.lit(":"), cents.cast("string")).alias("group_id"),
        (cents % 5).cast("int").alias("fold"),
        (F.col("value") / (F.col("value") + 50.0)).alias("score"),
        F.when(F.col("user_id") % 20 == 0, 1).otherwise(0).alias("label"),
    )


def oof(spark: SparkSession, sf: str) -> DataFrame:
    half = F.col("value") * 0.5 + F.col("user_id") % 97
    pairs = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed")) for m in MODELS for s in SEEDS
    ])
    score = F.when(F.col("model") == "ratio", F.col("value") / (F.col("value") + (F.col("seed") + 50))).otherwise(
        half / (half + (F.col("seed") + 40))
    )
    return (
        observations(spark, sf).withColumn("_m", F.explode(pairs)).select("*", "_m.*").drop("_m")
        .withColumn("score", score)
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return as_readings(spread(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey"))


def as_readings(lines: DataFrame) -> DataFrame:
    """lineitem rows; (order, line) is not unique there, so the row key also mixes in the other keys and the price."""
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = place * 1048576 + (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + cents) % 1048576
    return lines.select(
        F.col("l_linestatus").alias("segment"),
        key.alias("row_id"),
        *FEATURES, "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "orders"), "o_orderkey").select(
        F.col("o_orderstatus").alias("segment"), F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("x"), "o_custkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("label"),
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("lang").alias("segment"), F.col("doc_id").alias("row_id"), "source", F.col("n_chars").alias("x")
    )


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), "toxic")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "embeddings"), "vec_id").select(
        F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("segment"),
        F.col("vec_id").alias("row_id"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i:02d}") for i in range(64)],
    )


OBS = """obs AS (
  SELECT event_type AS segment, event_id AS row_id, ts, user_id, value,
         event_type || ':' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS group_id,
         CAST(CAST(round(value * 100) AS BIGINT) % 5 AS INTEGER) AS fold,
         value / (value + 50.0) AS score,
         CASE WHEN user_id % 20 = 0 THEN 1 ELSE 0 END AS label
  FROM events)"""

OOF = OBS + """, oof AS (
  SELECT o.segment, o.row_id, o.ts, o.user_id, o.value, o.group_id, o.fold, o.label, m.model, m.seed,
         CASE WHEN m.model = 'ratio' THEN o.value / (o.value + (m.seed + 50))
              ELSE (o.value * 0.5 + o.user_id % 97) / (o.value * 0.5 + o.user_id % 97 + (m.seed + 40)) END AS score
  FROM obs o CROSS JOIN (VALUES ('ratio', 1), ('ratio', 2), ('mixed', 1), ('mixed', 2)) m(model, seed))"""

READINGS = """readings AS (
  SELECT l_linestatus AS segment, (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 7919 + l_suppkey * 104729
           + CAST(round(l_extendedprice * 100) AS BIGINT)) % 1048576 AS row_id,
         l_quantity, l_discount, l_tax,
         l_extendedprice, l_partkey, l_suppkey, l_shipdate,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)"""

TIMED = """timed AS (
  SELECT o_orderstatus AS segment, o_orderkey AS row_id, o_orderdate AS ts, o_totalprice AS x, o_custkey,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label
  FROM orders)"""

DOCS = """docs AS (SELECT lang AS segment, doc_id AS row_id, source, n_chars AS x FROM documents),
doc_labels AS (SELECT doc_id AS row_id, quality AS label, toxic FROM labels)"""
