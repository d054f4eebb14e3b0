"""Join, set and evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.operators import budget, evidence, joins
from linetriage.operators.windows import average_rank
from linetriage.plans import views
from linetriage.plans.registry import query
from linetriage.sources.sinks import save, scratch_folder

DIMS = ["model", "seed"]


@query("J1", f"WITH {views.DOCS} SELECT d.segment, d.row_id, x, label, toxic FROM docs d JOIN doc_labels l ON d.row_id = l.row_id")
def labelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return joins.one_to_one(views.docs(spark, sf).drop("source"), views.doc_labels(spark, sf), ["row_id"])


@query("J2", f"""WITH {views.DOCS} SELECT count(*) AS rows, count(*) FILTER (l.row_id IS NULL) AS unmatched,
  count(*) FILTER (abs(x / 1000.0::DOUBLE - label) > 0.5) AS differing FROM docs d LEFT JOIN doc_labels l ON d.row_id = l.row_id""")
def left_report(spark: SparkSession, sf: str) -> DataFrame:
    left = views.docs(spark, sf).withColumn("guess", F.col("x") / 1000.0)
    return joins.left_report(left, views.doc_labels(spark, sf), ["row_id"], "guess", "label", 0.5)


@query("J3", f"""WITH {views.DOCS} SELECT coalesce(d.row_id, l.row_id) AS row_id, segment, toxic,
  CASE WHEN d.row_id IS NULL THEN 'right_only' WHEN l.row_id IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM (SELECT * FROM docs WHERE x > 300) d FULL OUTER JOIN doc_labels l ON d.row_id = l.row_id""")
def outer_sides(spark: SparkSession, sf: str) -> DataFrame:
    left = views.docs(spark, sf).where(F.col("x") > 300).select("row_id", "segment")
    return joins.full_outer(left, views.doc_labels(spark, sf).drop("label"), ["row_id"])


@query("J4", f"""WITH {views.OBS} SELECT segment, row_id FROM obs WHERE group_id IN (SELECT group_id FROM obs WHERE label = 1)""")
def rows_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf)
    positive = rows.where(F.col("label") == 1).select("group_id").distinct()
    return rows.join(positive, "group_id", "left_semi").select("segment", "row_id")


@query("J5", f"WITH {views.DOCS} SELECT segment, row_id FROM docs WHERE row_id NOT IN (SELECT row_id FROM doc_labels)")
def unlabelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return views.docs(spark, sf).join(views.doc_labels(spark, sf), "row_id", "left_anti").select("segment", "row_id")


PAIR_SQL = f"""WITH {views.OOF}, a AS (SELECT * FROM oof WHERE model = 'ratio'), b AS (SELECT * FROM oof WHERE model = 'mixed')"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["segment", "row_id", "fold", "label", "seed"]
    return joins.candidate_pairs(views.oof(spark, sf), keys, views.MODELS, "model")


@query("J6", PAIR_SQL + """ SELECT a.segment, a.row_id, a.fold, a.label, a.seed, round(a.score, 9) AS score_ratio, round(b.score, 9) AS score_mixed
FROM a JOIN b ON a.row_id = b.row_id AND a.seed = b.seed""")
def paired_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = _pairs(spark, sf)
    return out.withColumns({c: F.round(c, 9) for c in ("score_ratio", "score_mixed")})


def _share(column: str, table: str) -> str:
    return (f"(rank() OVER (PARTITION BY {table}.seed, {table}.segment, {table}.fold ORDER BY {column}) "
            f"+ (count(*) OVER (PARTITION BY {table}.seed, {table}.segment, {table}.fold, {column}) - 1) / 2.0) "
            f"/ count(*) OVER (PARTITION BY {table}.seed, {table}.segment, {table}.fold)::DOUBLE")


@query("M11 W3 J6", PAIR_SQL + f""", p AS (SELECT a.seed, a.segment, a.row_id, a.fold, a.score AS x, b.score AS y FROM a JOIN b ON a.row_id = b.row_id AND a.seed = b.seed)
SELECT seed, segment, row_id, round(({_share('x', 'p')} + {_share('y', 'p')}) / 2, 9) AS score FROM p""")
def rank_blend(spark: SparkSession, sf: str) -> DataFrame:
    scope = ["seed", "segment", "fold"]
    # Ranks pass over the pairs several times: they are written before each ranking instead of being made for each pass.
    folder = scratch_folder(spark)
    pairs = _pairs(spark, sf).drop("label")
    for name in views.MODELS:
        save(pairs, f"{folder}/{name}")
        pairs = average_rank(spark.read.schema(pairs.schema).parquet(f"{folder}/{name}"), scope, f"score_{name}", f"share_{name}").drop(f"score_{name}")
    blend = (F.col("share_ratio") + F.col("share_mixed")) / 2
    return pairs.select("seed", "segment", "row_id", F.round(blend, 9).alias("score"))


@query("M11 P12", PAIR_SQL + """ SELECT a.seed, a.segment, a.row_id, round((a.score + b.score) / 2, 9) AS half,
  round(CASE WHEN a.segment = 'click' THEN a.score ELSE (a.score + b.score) / 2 END, 9) AS routed FROM a JOIN b ON a.row_id = b.row_id AND a.seed = b.seed""")
def blend(spark: SparkSession, sf: str) -> DataFrame:
    from linetriage.operators.derive import route_by_segment

    pairs = _pairs(spark, sf).withColumn("half", (F.col("score_ratio") + F.col("score_mixed")) / 2)
    routed = route_by_segment(pairs, {"click": "score_ratio"}, "half", "routed")
    return routed.select("seed", "segment", "row_id", F.round("half", 9).alias("half"), F.round("routed", 9).alias("routed"))


@query("J7 A13", f"""WITH {views.OOF}, r AS (SELECT *, row_number() OVER (PARTITION BY model, seed, segment ORDER BY score DESC, row_id)
    <= ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY model, seed, segment)) AS sel FROM oof),
m AS (SELECT model, seed, coalesce(segment, 'all') AS segment, count(*) FILTER (sel AND label = 1) AS tp,
    count(*) FILTER (sel AND label = 1) / sum(label)::DOUBLE AS recall, 2.0::DOUBLE * count(*) FILTER (sel AND label = 1) / (count(*) FILTER (sel) + sum(label)) AS f1
  FROM r GROUP BY GROUPING SETS ((model, seed, segment), (model, seed)))
SELECT c.model, c.seed, c.segment, c.tp, round(c.recall, 6) AS recall, round(c.f1, 6) AS f1, b.tp AS baseline_tp,
  round(b.recall, 6) AS baseline_recall, round(b.f1, 6) AS baseline_f1, c.tp - b.tp AS delta_tp,
  round(c.recall - b.recall, 6) AS delta_recall, round(c.f1 - b.f1, 6) AS delta_f1
FROM m c JOIN m b ON c.seed = b.seed AND c.segment = b.segment AND b.model = 'ratio' AND c.model = 'mixed'""")
def delta_vs_base(spark: SparkSession, sf: str) -> DataFrame:
    table = budget.derived_policy_metrics(budget.policy_table(
        views.oof(spark, sf), DIMS, (0.1,), (budget.PER_SEGMENT,), folds=False, group=None, quality=False))
    metrics = ["tp", "recall", "f1"]
    out = joins.against_baseline(table.select(*DIMS, "segment", *metrics), "ratio", ["seed", "segment"], metrics)
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query("J8", f"""WITH {views.OBS}, b AS (SELECT row_id, CASE WHEN fold = 1 AND user_id % 2 = 0 THEN group_id || 'x'
    WHEN segment = 'view' AND fold = 2 THEN 'view-2' ELSE 'g' || group_id END AS group_id,
    CASE WHEN row_id % 2000 = 1 THEN 1 - label ELSE label END AS label FROM obs WHERE row_id % 3000 <> 2),
p AS (SELECT o.row_id AS ra, b.row_id AS rb, o.group_id AS ga, b.group_id AS gb, o.label AS ya, b.label AS yb FROM obs o FULL OUTER JOIN b ON o.row_id = b.row_id)
SELECT 'unmatched_rows' AS rule, count(*) FILTER (ra IS NULL OR rb IS NULL) AS failed_rows FROM p
UNION ALL SELECT 'changed_labels', count(*) FILTER (ya <> yb) FROM p
UNION ALL SELECT 'split_groups', count(*) FROM (SELECT ga FROM p WHERE ga IS NOT NULL GROUP BY ga HAVING count(DISTINCT gb) > 1)
UNION ALL SELECT 'merged_groups', count(*) FROM (SELECT gb FROM p WHERE gb IS NOT NULL GROUP BY gb HAVING count(DISTINCT ga) > 1)""")
def bijection(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf).select("segment", "row_id", "group_id", "label", "fold", "user_id")
    other = rows.where(F.col("row_id") % 3000 != 2).withColumns({
        "group_id": F.when((F.col("fold") == 1) & (F.col("user_id") % 2 == 0), F.concat("group_id", F.lit("x")))
        .when((F.col("segment") == "view") & (F.col("fold") == 2), "view-2").otherwise(F.concat(F.lit("g"), "group_id")),
        "label": F.when(F.col("row_id") % 2000 == 1, 1 - F.col("label")).otherwise(F.col("label")),
    })
    return joins.group_bijection(rows, other, ["row_id"])


@query("J9", """SELECT c_custkey AS row_id, n_name AS nation, r_name AS region FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def small_lookup(spark: SparkSession, sf: str) -> DataFrame:
    customers = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("n_nationkey"))
    nations = views.table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    named = joins.lookup(customers, nations, ["n_nationkey"], ["n_name", "r_regionkey"])
    placed = joins.lookup(named, views.table(spark, sf, "region"), ["r_regionkey"], ["r_name"])
    return placed.select("row_id", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("U1 S1", f"""WITH {views.OBS} SELECT segment, row_id, label FROM obs
UNION ALL SELECT o_orderstatus, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END FROM orders""")
def concatenated(spark: SparkSession, sf: str) -> DataFrame:
    first = views.observations(spark, sf).select("segment", "row_id", "label")
    return first.unionByName(views.timed(spark, sf).select("segment", "row_id", "label"))


@query("U2 U3", f"""WITH {views.OBS}, a AS (SELECT group_id FROM obs WHERE fold < 3), b AS (SELECT group_id FROM obs WHERE fold > 1)
SELECT (SELECT count(*) FROM (SELECT group_id FROM a EXCEPT SELECT group_id FROM b)) AS only_first,
  (SELECT count(*) FROM (SELECT group_id FROM b EXCEPT SELECT group_id FROM a)) AS only_second,
  (SELECT count(*) FROM (SELECT group_id FROM a INTERSECT SELECT group_id FROM b)) AS shared""")
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf)
    sides = rows.groupBy("group_id").agg(
        F.bool_or(F.col("fold") < 3).alias("a"), F.bool_or(F.col("fold") > 1).alias("b"))
    return sides.agg(
        F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("only_first"),
        F.count(F.when(F.col("b") & ~F.col("a"), 1)).alias("only_second"),
        F.count(F.when(F.col("a") & F.col("b"), 1)).alias("shared"),
    )


@query("U4", f"WITH {views.READINGS} SELECT DISTINCT segment, l_quantity, l_discount, l_tax FROM readings")
def distinct_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return views.readings(spark, sf).select("segment", *views.FEATURES).distinct()


EVIDENCE_SQL = """rec AS (SELECT event_type AS item, CASE WHEN user_id % 3 = 0 THEN 'confirmed' WHEN user_id % 3 = 1 THEN 'unconfirmed' ELSE 'mismatch' END AS status,
  'scope-' || (user_id % 4) AS scope_hash, 'user-' || user_id AS reviewer, epoch_us(ts) AS checked_micros, event_id AS version,
  sha256(CAST(event_id AS VARCHAR)) AS evidence_sha256, sha256(CAST(event_id + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS current_sha256 FROM events)"""


def evidence_records(spark: SparkSession, sf: str) -> DataFrame:
    user, version = F.col("user_id"), F.col("event_id")
    changed = version + F.when(version % 2 == 0, 1).otherwise(0)
    return views.table(spark, sf, "events").select(
        F.col("event_type").alias("item"),
        F.when(user % 3 == 0, "confirmed").when(user % 3 == 1, "unconfirmed").otherwise("mismatch").alias("status"),
        F.concat(F.lit("scope-"), (user % 4).cast("string")).alias("scope_hash"),
        F.concat(F.lit("user-"), user.cast("string")).alias("reviewer"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("checked_micros"), version.alias("version"),
        F.sha2(version.cast("string"), 256).alias("evidence_sha256"),
        F.sha2(changed.cast("string"), 256).alias("current_sha256"),
    )


ITEMS = ("click", "view", "purchase", "signup", "error", "raw_units")


@query("A38", f"""WITH {EVIDENCE_SQL}, i AS (SELECT unnest({list(ITEMS)}) AS item),
l AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY checked_micros DESC, version DESC) AS r FROM rec WHERE scope_hash = 'scope-2')
SELECT i.item, CASE WHEN status IS NULL THEN 'unconfirmed' WHEN status IN ('confirmed', 'mismatch') AND evidence_sha256 <> current_sha256 THEN 'mismatch' ELSE status END AS status,
  version, reviewer, checked_micros FROM i LEFT JOIN l ON i.item = l.item AND r = 1""")
def evidence_view(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.current_view(evidence_records(spark, sf), ITEMS, "scope-2")


@query("A38", f"""WITH {EVIDENCE_SQL} SELECT item, version, lag(version) OVER (PARTITION BY item ORDER BY checked_micros, version) AS previous_version FROM rec""")
def evidence_history(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.linked_history(evidence_records(spark, sf)).select("item", "version", "previous_version")


@query("A39", """WITH d AS (SELECT d.doc_id, nullif(d.lang, 'es') AS lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT unnest(['scope.lang', 'gate.quality', 'gate.review.toxic']) AS path,
  unnest([count(*) FILTER (lang IS NULL), count(*) FILTER (quality IS NULL), count(*) FILTER (toxic IS NULL)]) AS unset FROM d)
SELECT path, unset FROM c WHERE unset > 0""")
def unset_leaves(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.docs(spark, sf).join(views.doc_labels(spark, sf), "row_id", "left")
    nested = rows.select(
        "row_id", F.struct(F.nullif(F.col("segment"), F.lit("es")).alias("lang")).alias("scope"),
        F.struct(F.col("label").alias("quality"), F.struct("toxic").alias("review")).alias("gate"),
    )
    return evidence.unset_leaves(nested)
