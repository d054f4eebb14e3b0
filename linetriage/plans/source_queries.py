"""Reader, writer, profile and stream queries over the given tables and files derived from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.operators import rules
from linetriage.plans import model_queries, queue_queries, rule_queries, views
from linetriage.plans.registry import query
from linetriage.sources import inventory as files, profile as prof, readers, sinks
from linetriage.streaming import scoring

LABELLED = ("value", "score")


@query("S1 S9 U1", f"""WITH {views.OBS} SELECT segment, row_id, label, value, score FROM obs""")
def load_union(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV folder per segment, written and read back with the segment taken from the path."""
    folder = sinks.scratch_folder(spark) + "/measurements"
    rows = views.observations(spark, sf).select("row_id", "label", *LABELLED, F.col("segment").alias("line"))
    rows.write.partitionBy("line").mode("errorifexists").csv(folder, header=True)
    return readers.read_segments(spark, f"{folder}/line=*", LABELLED, True, r"line=([^/]+)/")


@query("S3 S9", """SELECT coalesce(CAST(o_orderkey AS VARCHAR), '') AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def text_columns(spark: SparkSession, sf: str) -> DataFrame:
    folder = sinks.scratch_folder(spark) + "/text"
    blank = F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_orderpriority"))
    rows = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", blank.alias("o_orderpriority"))
    sinks.save(rows, folder, "csv")
    return readers.read_text_columns(spark, folder, rows.columns)


@query("S4 S9", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def declared_encoding(spark: SparkSession, sf: str) -> DataFrame:
    folder = sinks.scratch_folder(spark) + "/declared"
    rows = views.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    sinks.save(rows, folder, "csv", sep="|", encoding="EUC-KR")
    return readers.read_declared(spark, folder, "euc-kr", "|")


@query("S5 S9", f"""WITH {views.OBS} SELECT row_id, segment, round(value, 2) AS value, label FROM obs""")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    folder = sinks.scratch_folder(spark) + "/json"
    rows = views.observations(spark, sf).select("row_id", "segment", F.round("value", 2).alias("value"), "label")
    sinks.save(rows, folder, "json")
    return readers.read_json_records(spark, folder, schema=rows.schema).select(*rows.columns)


@query("S5", """SELECT event_id AS row_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "k long")
    return views.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), parsed["k"].alias("k"))


@query("S2", "SELECT CAST(11 AS INTEGER) AS columns, 0 AS repeated, least(count(*), 100) AS sampled FROM lineitem")
def sample_reader(spark: SparkSession, sf: str) -> DataFrame:
    frame, facts = readers.read_sample(spark, f"{sf}/lineitem.parquet", "parquet", 100)
    return frame.agg(F.count(F.lit(1)).alias("sampled")).select(
        F.lit(facts["columns"]).alias("columns"), F.lit(len(facts["repeated"])).alias("repeated"), "sampled")


@query("S6")
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return files.file_digests(spark, f"{sf}/*.parquet")


@query("S7", "SELECT 'same' AS state, 14::BIGINT AS files")
def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """Digests written as a manifest, read back and compared with the files again."""
    folder = sinks.scratch_folder(spark) + "/manifest"
    found = files.file_digests(spark, f"{sf}/*.parquet")
    sinks.save(found, folder, "json")
    checked = files.against_manifest(found, spark.read.schema(found.schema).json(folder))
    return checked.groupBy("state").agg(F.count(F.lit(1)).alias("files"))


@query("S7", """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 12) AS BIGINT))
  AS VARCHAR) AS checksum FROM orders""")
def table_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return prof.checksum(views.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


ORDER_KINDS = {"row_id": "bigint", "segment": "string", "source": "string", "x": "bigint", "label": "int", "toxic": "int"}


@query("S8", f"""WITH {views.DOCS}, t AS (SELECT d.row_id, segment, source, x, label, toxic FROM docs d LEFT JOIN doc_labels l ON d.row_id = l.row_id) """
       + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM t"
    for c, k in ORDER_KINDS.items()))
def profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.docs(spark, sf).join(views.doc_labels(spark, sf), "row_id", "left")
    return prof.profile(rows.select(*ORDER_KINDS))


@query("S11 A9", f"""WITH {views.OOF} SELECT model, seed, 0.1::DOUBLE AS fraction, count(*) AS rows, sum(label)::BIGINT AS positives FROM oof GROUP BY model, seed""")
def aggregate_export(spark: SparkSession, sf: str) -> DataFrame:
    """Only the aggregate table may be written; the written file is read back."""
    from linetriage.operators import budget

    table = budget.policy_table(
        views.oof(spark, sf), ("model", "seed"), (0.1, 0.2), (budget.GLOBAL,), folds=False, group=None, quality=False)
    pooled = table.where(F.col("segment") == budget.ALL).select("model", "seed", "fraction", "rows", "positives")
    allowed = ["model", "seed", "fraction", "rows", "positives", "found", "recall"]
    folder = sinks.scratch_folder(spark) + "/export"
    sinks.save(sinks.export_aggregates(pooled, allowed, 0.1), folder)
    return spark.read.parquet(folder)


@query("S12 S9", f"WITH {queue_queries.QUEUE_SQL} SELECT segment, row_id, global_rank, priority FROM queue WHERE global_rank BETWEEN 101 AND 150")
def stored_page(spark: SparkSession, sf: str) -> DataFrame:
    """Queue stored once; a page is a rank filter that reaches the parquet scan."""
    from linetriage.operators import queue as q

    folder = sinks.scratch_folder(spark) + "/queue"
    sinks.save(queue_queries.queue(spark, sf), folder)
    return q.page(spark.read.parquet(folder), 100, 50).select("segment", "row_id", "global_rank", "priority")


SUBMISSION_SQL = """ref AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders),
cand AS (SELECT CASE WHEN o_orderkey % 1000 = 17 THEN CAST(o_orderkey - 1 AS VARCHAR) WHEN o_orderkey % 2000 = 5 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS id,
  CASE WHEN o_orderkey % 700 = 3 THEN ' ' WHEN o_orderkey % 900 = 4 THEN 'n/a' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS score,
  CASE WHEN o_orderkey % 800 = 6 THEN '2' ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS label, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders)"""


@query("Q7 S3", f"""WITH {SUBMISSION_SQL}, j AS (SELECT c.id AS a, r.id AS b FROM cand c FULL OUTER JOIN ref r ON c.line = r.line)
SELECT 'blank_id' AS rule, count(*) FILTER (trim(id) = '') AS failed_rows, min(CASE WHEN trim(id) = '' THEN id END) AS first_key FROM cand
UNION ALL SELECT 'blank_score', count(*) FILTER (trim(score) = ''), min(CASE WHEN trim(score) = '' THEN id END) FROM cand
UNION ALL SELECT 'not_numeric_score', count(*) FILTER (TRY_CAST(score AS DOUBLE) IS NULL), min(CASE WHEN TRY_CAST(score AS DOUBLE) IS NULL THEN id END) FROM cand
UNION ALL SELECT 'blank_label', 0, NULL
UNION ALL SELECT 'not_allowed_label', count(*) FILTER (label NOT IN ('0', '1')), min(CASE WHEN label NOT IN ('0', '1') THEN id END) FROM cand
UNION ALL SELECT 'duplicate_id', count(*), min(id) FROM (SELECT id FROM cand GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'id_order', count(*) FILTER (a <> b), min(CASE WHEN a <> b THEN a END) FROM j
UNION ALL SELECT 'row_count', 0, NULL UNION ALL SELECT 'columns', 0, NULL""")
def submission_check(spark: SparkSession, sf: str) -> DataFrame:
    """A derived submission and its reference, each written as one ordered text file set and read back as text."""
    key = F.col("o_orderkey")
    orders = views.table(spark, sf, "orders").select("o_orderkey")
    ordered = orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    candidate = ordered.select(
        F.when(key % 1000 == 17, (key - 1).cast("string")).when(key % 2000 == 5, "").otherwise(key.cast("string")).alias("id"),
        F.when(key % 700 == 3, " ").when(key % 900 == 4, "n/a").otherwise((key % 100).cast("string")).alias("score"),
        F.when(key % 800 == 6, "2").otherwise((key % 2).cast("string")).alias("label"),
    )
    reference = ordered.select(key.cast("string").alias("id"), F.lit("0").alias("score"), F.lit("0").alias("label"))
    folder = sinks.scratch_folder(spark)
    names = ["id", "score", "label"]
    texts = []
    for name, frame in (("candidate", candidate), ("reference", reference)):
        sinks.save(frame, f"{folder}/{name}", "csv", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        # Part files are numbered in range order, so (file, place in file) is the order of the lines.
        texts.append(readers.read_text_columns(spark, f"{folder}/{name}", names, lines=True))
    return rules.submission_faults(texts[0], texts[1], "id", ["score", "label"], ["score"], {"label": ["0", "1"]})


STREAM_SQL = model_queries.LINEAR_SQL + ", b AS (SELECT segment, " + ", ".join(
    f"quantile_cont({f}, {s}) AS {side}_{f}" for f in model_queries.COEFS for s, side in ((0.1, "low"), (0.9, "high"))
) + " FROM readings GROUP BY segment)"


@query("P6 P8 P11", f"""WITH {STREAM_SQL}, o AS (SELECT z.*, """ + " + ".join(
    f"(CASE WHEN {f} < low_{f} OR {f} > high_{f} THEN 1 ELSE 0 END)" for f in model_queries.COEFS
) + """ AS ood_feature_count FROM z JOIN b ON z.segment = b.segment)
SELECT segment, row_id, round(1 / (1 + exp(-z)), 6) AS score, ood_feature_count,
  CASE WHEN segment = 'O' THEN 'usual_inspection_unvalidated_machine' WHEN ood_feature_count >= 3 THEN 'usual_inspection_ood'
  ELSE 'usual_inspection_label_unconfirmed' END AS action FROM o""")
def stream_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table arrives as a stream and is scored exactly once."""
    from linetriage.operators.quantiles import range_bounds

    features = list(model_queries.COEFS)
    batch = views.readings(spark, sf)
    raw = scoring.read_stream(spark, f"{sf}/lineitem*.parquet", views.table(spark, sf, "lineitem").schema)
    rows = views.as_readings(raw)
    scored = scoring.score_stream(
        rows, model_queries.linear_weights(spark, sf), range_bounds(batch, features, 0.1, 0.9), features, ["O"])
    folder = sinks.scratch_folder(spark)
    scoring.write_once(
        scored.select("segment", "row_id", F.round("score", 6).alias("score"), "ood_feature_count", "action"),
        f"{folder}/scored", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/scored")


@query("Q17", rule_queries.TIMES_SQL)
def stream_arrival(spark: SparkSession, sf: str) -> DataFrame:
    raw = scoring.read_stream(spark, f"{sf}/events*.parquet", views.table(spark, sf, "events").schema)
    rows = rule_queries.with_times(raw.withColumnRenamed("event_id", "row_id"))
    folder = sinks.scratch_folder(spark)
    scoring.write_once(
        scoring.check_arrival(rows, ["row_id", "unit"]).select("row_id", "in_time"),
        f"{folder}/checked", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/checked")


@query("S7", """WITH t AS (SELECT unnest(string_split('region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations', ' ')) || '.parquet' AS name
  UNION ALL SELECT 'lost.parquet')
SELECT name, CASE name WHEN 'orders.parquet' THEN 'changed' WHEN 'nation.parquet' THEN 'unexpected' WHEN 'lost.parquet' THEN 'missing' ELSE 'same' END AS state FROM t""")
def manifest_tampered_files(spark: SparkSession, sf: str) -> DataFrame:
    """States of the given files against a manifest with another digest, an entry less and an entry for no file."""
    folder = sinks.scratch_folder(spark) + "/manifest"
    found = files.file_digests(spark, f"{sf}/*.parquet")
    told = found.where("name <> 'nation.parquet'").withColumn(
        "sha256", F.when(F.col("name") == "orders.parquet", F.reverse("sha256")).otherwise(F.col("sha256"))).unionByName(
        spark.createDataFrame([("lost.parquet", 1, "00")], found.schema))
    sinks.save(told, folder, "json")
    return files.against_manifest(found, spark.read.schema(found.schema).json(folder)).select("name", "state")


@query("S10 S9", f"""WITH {views.OBS} SELECT segment, count(*) AS rows, sum(label)::BIGINT AS positives, max(round(value * 100))::BIGINT AS top_cents,
  TRUE AS second_write_refused FROM obs GROUP BY segment""")
def report_written(spark: SparkSession, sf: str) -> DataFrame:
    """A nested report per segment, written once, read back; a second write to its place is refused and changes nothing."""
    path = sinks.scratch_folder(spark) + "/report"
    report = views.observations(spark, sf).groupBy("segment").agg(F.struct(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"),
        F.struct(F.max(F.round(F.col("value") * 100)).cast("long").alias("top_cents")).alias("value")).alias("summary"))
    sinks.save_report(report, path)
    try:
        sinks.save_report(report.limit(0), path)
        refused = False
    except AnalysisException as fault:
        refused = "PATH_ALREADY_EXISTS" in str(fault)
    back = spark.read.schema(report.schema).json(path)
    return back.select("segment", "summary.rows", "summary.positives", "summary.value.top_cents", F.lit(refused).alias("second_write_refused"))
