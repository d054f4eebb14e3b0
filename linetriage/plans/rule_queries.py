"""Data-quality and verification queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.functions.sizing import small_table
from linetriage.operators import budget, choose, quality, rules
from linetriage.operators.ordering import rank_rows
from linetriage.plans import views
from linetriage.plans.registry import query

DIMS = ["model", "seed"]


@query("Q2", """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'null_key' AS rule, count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL) AS failed_rows,
  min(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN concat_ws(':', l_orderkey, l_linenumber) END) AS first_key FROM lineitem
UNION ALL SELECT 'duplicate_key', count(*) FILTER (n > 1), min(CASE WHEN n > 1 THEN l_orderkey || ':' || l_linenumber END) FROM k""")
def dup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return rules.duplicate_keys(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q3 Q4 Q16", """WITH d AS (SELECT d.doc_id AS row_id, n_chars, quality AS label, n_chars / 2000.0::DOUBLE AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'label_domain' AS rule, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS failed_rows,
  min(CASE WHEN label IS NULL OR label NOT IN (0, 1) THEN row_id::VARCHAR END) AS first_key FROM d
UNION ALL SELECT 'not_finite', count(*) FILTER (n_chars IS NULL), min(CASE WHEN n_chars IS NULL THEN row_id::VARCHAR END) FROM d
UNION ALL SELECT 'score_range', count(*) FILTER (score IS NULL OR score < 0 OR score > 1),
  min(CASE WHEN score IS NULL OR score < 0 OR score > 1 THEN row_id::VARCHAR END) FROM d""")
def row_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.docs(spark, sf).join(views.doc_labels(spark, sf), "row_id", "left").withColumn(
        "score", F.col("x") / 2000.0)
    return rules.check_rows(rows, {
        "label_domain": rules.label_domain(), "not_finite": rules.not_finite("x"), "score_range": rules.bad_score(),
    }, ["row_id"])


@query("Q6", """WITH b AS (SELECT event_type AS segment, CASE WHEN event_id % 1000 = 7 THEN event_id - 1 WHEN event_id % 1000 = 9 THEN -event_id
    ELSE event_id END AS row_id FROM events), k AS (SELECT segment, row_id, count(*) AS n FROM b GROUP BY ALL)
SELECT 'unknown_segment' AS rule, count(*) FILTER (segment NOT IN ('click', 'view', 'purchase', 'signup')) AS failed_rows,
  min(CASE WHEN segment NOT IN ('click', 'view', 'purchase', 'signup') THEN segment || ':' || row_id END) AS first_key FROM b
UNION ALL SELECT 'id_range', count(*) FILTER (row_id < 0), min(CASE WHEN row_id < 0 THEN segment || ':' || row_id END) FROM b
UNION ALL SELECT 'not_finite', 0, NULL UNION ALL SELECT 'null_key', 0, NULL
UNION ALL SELECT 'duplicate_key', count(*) FILTER (n > 1), min(CASE WHEN n > 1 THEN segment || ':' || row_id END) FROM k""")
def batch_contract(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("row_id")
    rows = views.observations(spark, sf).select("segment", F.when(key % 1000 == 7, key - 1).when(
        key % 1000 == 9, -key).otherwise(key).alias("row_id"), "value", "score")
    return rules.scoring_batch(rows, ["value", "score"], ["click", "view", "purchase", "signup"])


OOF_BAD = f"""{views.OOF}, bad AS (
  SELECT segment, row_id, fold, CASE WHEN row_id % 500 = 1 AND model = 'mixed' THEN 1 - label ELSE label END AS label, model, seed,
    CASE WHEN row_id % 700 = 2 AND seed = 2 THEN score + 1 ELSE score END AS score
  FROM oof WHERE NOT (row_id % 900 = 3 AND model = 'ratio') AND row_id % 1100 <> 4
  UNION ALL SELECT segment, row_id, fold, label, model, seed, score FROM oof WHERE row_id % 1300 = 5 AND model = 'ratio' AND seed = 1),
ours AS (SELECT segment, row_id, fold, label, count(*) AS n FROM bad GROUP BY ALL)"""


@query("Q9", f"""WITH {OOF_BAD}, both_ AS (SELECT o.segment, o.row_id, o.row_id AS a, x.row_id AS b, n FROM obs o
  FULL OUTER JOIN ours x ON o.segment = x.segment AND o.row_id = x.row_id AND o.fold = x.fold AND o.label = x.label)
SELECT 'score_range' AS rule, count(*) FILTER (score < 0 OR score > 1) AS failed_rows,
  min(CASE WHEN score < 0 OR score > 1 THEN model || ':' || seed || ':' || segment || ':' || row_id END) AS first_key FROM bad
UNION ALL SELECT 'unknown_pair', 0, NULL
UNION ALL SELECT 'duplicate_row', count(*), min(k) FROM (SELECT model || ':' || seed || ':' || segment || ':' || row_id AS k FROM bad GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'never_scored', count(*) FILTER (b IS NULL), min(CASE WHEN b IS NULL THEN segment || ':' || row_id END) FROM both_
UNION ALL SELECT 'identity_differs', count(*) FILTER (a IS NULL), NULL FROM both_
UNION ALL SELECT 'incomplete_pairs', count(*) FILTER (n <> 4 AND a IS NOT NULL), min(CASE WHEN n <> 4 AND a IS NOT NULL THEN segment || ':' || row_id END) FROM both_""")
def oof_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.oof(spark, sf).select("segment", "row_id", "fold", "label", *DIMS, "score")
    key, model = F.col("row_id"), F.col("model")
    bad = rows.where(~((key % 900 == 3) & (model == "ratio")) & (key % 1100 != 4)).withColumns({
        "label": F.when((key % 500 == 1) & (model == "mixed"), 1 - F.col("label")).otherwise(F.col("label")),
        "score": F.when((key % 700 == 2) & (F.col("seed") == 2), F.col("score") + 1).otherwise(F.col("score")),
    })
    twice = rows.where((key % 1300 == 5) & (model == "ratio") & (F.col("seed") == 1))
    expected = views.observations(spark, sf).select("segment", "row_id", "fold", "label")
    return rules.oof_faults(bad.unionByName(twice), expected, views.MODELS, views.SEEDS)


COHORT_SQL = """c AS (SELECT segment, count(*) AS rows, sum(label)::BIGINT AS positives, count(DISTINCT group_id) AS groups,
  count(DISTINCT fold) AS folds FROM obs GROUP BY segment)"""


@query("Q10", f"""WITH {views.OBS}, {COHORT_SQL}, w AS (SELECT segment, count(*) FILTER (value > 0.5 AND fold <> 3) AS rows,
  (sum(label) FILTER (value > 0.5 AND fold <> 3))::BIGINT AS positives, count(DISTINCT group_id) FILTER (value > 0.5 AND fold <> 3) AS groups, count(DISTINCT fold) FILTER (value > 0.5 AND fold <> 3) AS folds FROM obs GROUP BY segment)
SELECT * FROM (SELECT segment, unnest(['rows', 'positives', 'groups', 'folds']) AS fact,
    unnest([w.rows, w.positives, w.groups, w.folds])::DOUBLE AS expected, unnest([c.rows, c.positives, c.groups, c.folds])::DOUBLE AS actual
  FROM c JOIN w USING (segment)) WHERE expected IS DISTINCT FROM actual""")
def cohort_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf)
    return rules.cohort_differences(rules.cohort(rows), rules.cohort(rows.where("value > 0.5 and fold <> 3")))


SPLIT_BAD = views.OBS + """, m AS (SELECT segment, row_id, group_id, CASE WHEN user_id % 5 = 0 THEN 'holdout' WHEN user_id % 97 = 1 THEN 'test' ELSE 'development' END AS part,
  CASE WHEN user_id % 50 = 0 THEN fold WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 31 = 2 THEN 7 ELSE fold END AS fold FROM obs)"""


@query("Q11", f"""WITH {SPLIT_BAD}, g AS (SELECT group_id, coalesce(min(part) < max(part), false) AS p, coalesce(min(fold) < max(fold), false) AS f FROM m GROUP BY group_id)
SELECT 'partition_name' AS rule, count(*) FILTER (part = 'test') AS failed_rows, min(CASE WHEN part = 'test' THEN segment || ':' || row_id END) AS first_key FROM m
UNION ALL SELECT 'development_fold', count(*) FILTER (part = 'development' AND (fold IS NULL OR fold > 4)),
  min(CASE WHEN part = 'development' AND (fold IS NULL OR fold > 4) THEN segment || ':' || row_id END) FROM m
UNION ALL SELECT 'holdout_fold', count(*) FILTER (part = 'holdout' AND fold IS NOT NULL), min(CASE WHEN part = 'holdout' AND fold IS NOT NULL THEN segment || ':' || row_id END) FROM m
UNION ALL SELECT 'group_in_partitions', count(*) FILTER (p), min(CASE WHEN p THEN group_id END) FROM g
UNION ALL SELECT 'group_in_folds', count(*) FILTER (f), min(CASE WHEN f THEN group_id END) FROM g""")
def split_check(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    manifest = views.observations(spark, sf).withColumns({
        "partition": F.when(user % 5 == 0, "holdout").when(user % 97 == 1, "test").otherwise("development"),
        "fold": F.when(user % 50 == 0, F.col("fold")).when(user % 5 == 0, None).when(user % 31 == 2, 7).otherwise(F.col("fold")),
    })
    return rules.split_membership(manifest, 5)


@query("Q12 J4 U3", f"""WITH {views.OBS}, l AS (SELECT *, CAST(row_id % 5 AS INTEGER) AS leaky FROM obs),
x AS (SELECT group_id, count(DISTINCT leaky) > 1 AS leaks FROM l GROUP BY group_id)
SELECT leaky, count(*) AS rows, count(DISTINCT group_id) FILTER (leaks) AS shared_groups FROM l JOIN x USING (group_id) GROUP BY leaky""")
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf).withColumn("leaky", (F.col("row_id") % 5).cast("int"))
    return rules.fold_leakage(rows, "leaky")


@query("Q12 J5", f"""WITH {views.OBS} SELECT 'shared_groups' AS rule, count(*) AS failed_rows, min(group_id) AS first_key FROM (
  SELECT group_id FROM obs WHERE row_id % 5 <> 0 INTERSECT SELECT group_id FROM obs WHERE row_id % 5 = 0)""")
def leak_between(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf)
    return rules.leakage(rows.where(F.col("row_id") % 5 != 0), rows.where(F.col("row_id") % 5 == 0))


@query("Q13", f"""WITH {views.OBS} SELECT fold, segment, count(*) AS rows, sum(label)::BIGINT AS positives,
  count(DISTINCT label) = 2 AS both_classes FROM obs GROUP BY fold, segment""")
def fold_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rules.fold_coverage(views.observations(spark, sf))


@query("Q14", f"""WITH {views.OBS}, g AS (SELECT group_id, count(DISTINCT value) > 1 AS v, count(DISTINCT user_id) > 1 AS u FROM obs GROUP BY group_id)
SELECT 'differs_value' AS rule, count(*) FILTER (v) AS failed_rows, min(CASE WHEN v THEN group_id END) AS first_key FROM g
UNION ALL SELECT 'differs_user_id', count(*) FILTER (u), min(CASE WHEN u THEN group_id END) FROM g""")
def group_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return rules.group_integrity(views.observations(spark, sf), ["value", "user_id"])


@query("Q15", f"""WITH {views.OOF}, g AS (SELECT model, seed, group_id, max(score) - min(score) AS s FROM oof GROUP BY ALL)
SELECT model, seed, count(*) AS groups, count(*) FILTER (s > 1e-12) AS groups_with_spread, round(max(s), 6) AS largest_spread
FROM g GROUP BY model, seed""")
def score_spread(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.score_spread(views.oof(spark, sf), DIMS)
    return out.withColumn("largest_spread", F.round("largest_spread", 6))


TIMES_SQL = """SELECT event_id AS row_id, CASE WHEN user_id % 41 = 0 THEN false ELSE
    ts + to_seconds(CAST(user_id % 90 AS INTEGER)) <= ts + INTERVAL 60 SECOND
    AND ts + to_seconds(CAST(user_id % 75 AS INTEGER)) <= ts + INTERVAL 60 SECOND END AS in_time FROM events"""


def with_times(rows: DataFrame) -> DataFrame:
    """Derived point-in-time fields: cutoff a minute after the event, arrival times that depend on the user."""
    at = F.col("ts").cast("timestamp")
    def later(seconds):
        return F.timestamp_micros(F.unix_micros(at) + seconds * 1_000_000)

    user = F.col("user_id")
    return rows.withColumns({
        "cutoff": later(F.lit(60)), "ended": later(user % 90),
        "available": F.create_map(F.lit("a"), at, F.lit("b"), later(user % 75)),
        "unit": F.when(user % 41 == 0, " ").otherwise("mm"),
    })


@query("Q17", TIMES_SQL)
def asof_available(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_times(views.observations(spark, sf))
    return rules.available_in_time(rows, "cutoff", "ended", "available", ["row_id", "unit"]).select("row_id", "in_time")


LEDGER_SQL = views.OOF + """, seen AS (SELECT DISTINCT model, seed, fold, segment FROM oof WHERE NOT (fold = 3 AND segment = 'click' AND model = 'mixed')),
want AS (SELECT model, seed, fold, segment FROM (SELECT unnest(['ratio', 'mixed']) AS model) a, (SELECT unnest([1, 2]) AS seed) b,
  (SELECT unnest([0, 1, 2, 3, 4]) AS fold) c, (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error_2']) AS segment) d)"""


@query("Q18 U2", f"""WITH {LEDGER_SQL} SELECT model, seed, fold, segment, 'missing' AS fault FROM (SELECT * FROM want EXCEPT SELECT * FROM seen)
UNION ALL SELECT model, seed, fold, segment, 'unexpected' FROM (SELECT * FROM seen EXCEPT SELECT * FROM want)""")
def ledger_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.oof(spark, sf)
    lost = (F.col("fold") == 3) & (F.col("segment") == "click") & (F.col("model") == "mixed")
    seen = rows.where(~lost).select("model", "seed", "fold", "segment").distinct()
    return rules.ledger_gaps(seen, {
        "model": views.MODELS, "seed": views.SEEDS, "fold": range(5),
        "segment": ("click", "view", "purchase", "signup", "error_2"),
    })


@query("Q18", f"""WITH {views.OOF}, c AS (SELECT model, seed, fold, segment, count(*) AS fit_rows, sum(label)::BIGINT AS fit_positives FROM oof GROUP BY ALL)
SELECT model, seed, fold, segment, fit_rows + 1 AS fit_rows, fit_positives FROM c WHERE fit_positives % 7 = 0""")
def ledger_counts(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["model", "seed", "fold", "segment"]
    counts = views.oof(spark, sf).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fit_rows"), F.sum("label").alias("fit_positives"))
    wrong = F.col("fit_rows") + F.when(F.col("fit_positives") % 7 == 0, 1).otherwise(0)
    out = rules.ledger_counts(counts.withColumn("fit_rows", wrong), counts, keys, ["fit_rows", "fit_positives"])
    return out.select(*keys, "fit_rows", "fit_positives")


REPLAY_SQL = views.OOF + """, th AS (SELECT t.model, t.seed, f.fold AS fold, quantile_cont(score, 0.9) AS threshold FROM oof t
  JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f ON t.fold <> f.fold GROUP BY ALL)"""


@query("Q19 P12", f"""WITH {REPLAY_SQL}, s AS (SELECT o.*, threshold, CASE WHEN user_id % 33 = 4 THEN NOT (score >= threshold) ELSE score >= threshold END AS d
  FROM oof o JOIN th ON o.model = th.model AND o.seed = th.seed AND o.fold = th.fold)
SELECT model, seed, fold, count(*) AS rows, count(*) FILTER (d <> (score >= threshold)) AS failed_rows FROM s GROUP BY ALL""")
def decision_replay(spark: SparkSession, sf: str) -> DataFrame:
    from linetriage.operators.quantiles import quantiles

    rows = views.oof(spark, sf)
    trained = rows.select(*DIMS, "fold", "score").withColumn(
        "target", F.explode(F.array(*[F.lit(k) for k in range(5)]))).where(F.col("target") != F.col("fold"))
    found = quantiles(trained.drop("fold").withColumnRenamed("target", "fold"), [*DIMS, "fold"], "score", [0.9])
    thresholds = found.withColumnRenamed("quantile", "threshold").drop("share")
    thresholds = small_table(thresholds)
    passed = F.col("score") >= F.col("threshold")
    stored = rows.join(thresholds, [*DIMS, "fold"]).withColumn(
        "decision", F.when(F.col("user_id") % 33 == 4, ~passed).otherwise(passed)).drop("threshold")
    return rules.decision_faults(stored, thresholds, [*DIMS, "fold"])


def _both_metrics(spark: SparkSession, sf: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Budget metrics from boundary rows, and the same from full ranks."""
    rows = views.oof(spark, sf).select(*DIMS, "segment", "row_id", "label", "score")
    saved = budget.policy_table(
        rows, DIMS, (0.1,), (budget.PER_SEGMENT,), folds=False, group=None, quality=False
    ).where(F.col("segment") != budget.ALL).select(*keys, "rows", "k", "found", "recall", "precision")
    ranked = rank_rows(rows, keys, ties=("row_id",))
    sizes = small_table(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    chosen = ranked.join(sizes, keys).withColumn("decision", F.col("rank") <= F.ceil(F.lit(0.1) * F.col("n")))
    again = quality.confusion(chosen, keys).select(
        *keys, "rows", "k", F.col("tp").alias("found"), "recall", "precision")
    return saved, again


@query("Q20", f"""WITH {views.OOF}, c AS (SELECT count(DISTINCT model || seed || segment) AS cells FROM oof)
SELECT unnest(['rows', 'k', 'found', 'recall', 'precision']) AS metric, cells, 0::BIGINT AS failed_cells FROM c""")
def metric_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Budget metrics from boundary rows against the same metrics from full ranks: no cell may differ."""
    keys = [*DIMS, "segment"]
    return rules.metric_replay(*_both_metrics(spark, sf, keys), keys)


WINNER_SQL = views.OOF + """, r AS (SELECT *, row_number() OVER (PARTITION BY model, seed, fold, segment ORDER BY score DESC, row_id) AS i,
    count(*) OVER (PARTITION BY model, seed, fold, segment) AS n FROM oof),
f AS (SELECT fold, segment, model || '_' || seed AS candidate, sum(label) FILTER (i <= ceil(0.1::DOUBLE * n))::BIGINT AS found,
    CASE WHEN model = 'ratio' THEN 0 ELSE 2 END + seed AS priority, sum(label)::BIGINT AS positives FROM r GROUP BY ALL),
win AS (SELECT *, row_number() OVER (PARTITION BY fold, segment ORDER BY found DESC, positives DESC, priority) AS place FROM f)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Found-at-budget of each candidate per fold and segment."""
    rows = views.oof(spark, sf).withColumn("candidate", F.concat_ws("_", "model", "seed"))
    rows = rows.select("candidate", "fold", "segment", "row_id", "label", "score")
    chosen = budget.select(rows, 0.1, dims=["candidate", "fold"])
    return chosen.groupBy("fold", "segment", "candidate").agg(
        F.sum(F.when(F.col("selected"), F.col("label")).otherwise(0)).alias("found"),
        F.sum("label").alias("positives"),
    )


ORDER = ("ratio_1", "ratio_2", "mixed_1", "mixed_2")


@query("T4 M9", f"WITH {WINNER_SQL} SELECT fold, segment, candidate AS winner, found FROM win WHERE place = 1")
def winners(spark: SparkSession, sf: str) -> DataFrame:
    return choose.best(candidates(spark, sf), ["fold", "segment"], ["found", "positives"], ORDER).select(
        "fold", "segment", F.col("candidate").alias("winner"), "found")


@query("Q21", f"""WITH {WINNER_SQL} SELECT w.fold, w.segment, CASE WHEN w.fold = 2 THEN 'mixed_2' ELSE w.candidate END AS stored, w.candidate AS again
FROM win w WHERE place = 1 AND CASE WHEN w.fold = 2 THEN 'mixed_2' ELSE w.candidate END <> w.candidate""")
def selection_replay(spark: SparkSession, sf: str) -> DataFrame:
    again = choose.best(candidates(spark, sf), ["fold", "segment"], ["found", "positives"], ORDER)
    stored = again.withColumn("candidate", F.when(F.col("fold") == 2, "mixed_2").otherwise(F.col("candidate")))
    return choose.replay(stored, again, ["fold", "segment"])


@query("Q22", f"""WITH {views.OOF}, c AS (SELECT model, seed, segment, count(*) AS rows, sum(label)::BIGINT AS positives, count(DISTINCT group_id) AS groups
  FROM oof WHERE NOT (model = 'mixed' AND segment = 'view' AND row_id % 100 = 0) GROUP BY ALL)
SELECT a.seed, a.segment, a.rows = b.rows AND a.positives = b.positives AND a.groups = b.groups AS comparable
FROM c a JOIN c b ON a.seed = b.seed AND a.segment = b.segment AND a.model = 'ratio' AND b.model = 'mixed'""")
def cohort_equality(spark: SparkSession, sf: str) -> DataFrame:
    gone = (F.col("model") == "mixed") & (F.col("segment") == "view") & (F.col("row_id") % 100 == 0)
    per_group = views.oof(spark, sf).where(~gone).groupBy(*DIMS, "segment", "group_id").agg(
        F.count(F.lit(1)).alias("r"), F.sum("label").alias("p"))
    facts = per_group.groupBy(*DIMS, "segment").agg(
        F.sum("r").alias("rows"), F.sum("p").alias("positives"), F.count(F.lit(1)).alias("groups"))
    ours, theirs = (facts.where(F.col("model") == m).drop("model") for m in views.MODELS)
    return rules.comparable(ours, theirs, ["seed", "segment"], ["rows", "positives", "groups"])


@query("Q20", f"""WITH {views.OOF}, c AS (SELECT model, seed, segment, sum(label) > 0 AS hits, model = 'ratio' AND seed = 1 AS told,
  model = 'mixed' AND seed = 2 AND segment = (SELECT min(segment) FROM oof) AS lost FROM oof GROUP BY ALL)
SELECT metric, count(*) AS cells, count(*) FILTER (CASE metric WHEN 'found' THEN told OR lost WHEN 'recall' THEN lost AND hits ELSE lost END) AS failed_cells
FROM c CROSS JOIN (SELECT unnest(['rows', 'k', 'found', 'recall', 'precision']) AS metric) GROUP BY metric""")
def metric_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Faults found in stored metrics of which one cell was taken and one model's hits were raised by one."""
    keys = [*DIMS, "segment"]
    saved, again = _both_metrics(spark, sf, keys)
    first = views.observations(spark, sf).agg(F.min("segment")).first()[0]
    lost = (F.col("model") == "mixed") & (F.col("seed") == 2) & (F.col("segment") == F.lit(first))
    told = saved.where(~lost).withColumn("found", F.col("found") + F.when((F.col("model") == "ratio") & (F.col("seed") == 1), 1).otherwise(0))
    return rules.metric_replay(told, again, keys)


@query("Q1", """SELECT t AS variant, t = 'orders' AS loads, count(CASE WHEN t = 'orders' THEN o_totalprice END) AS checked_rows, 0::BIGINT AS not_finite
FROM orders CROSS JOIN (SELECT unnest(['orders', 'fewer', 'more', 'twice', 'reordered', 'text']) AS t) GROUP BY t""")
def schema_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which variants of a table the column rules let load, with the rows then checked: as it is, a column less, one more, one twice, another order, numbers as text."""
    base = views.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    names = base.columns
    variants = {
        "orders": base, "fewer": base.drop("o_custkey"), "more": base.withColumn("extra", F.lit(1)),
        "twice": base.select(*names, "o_custkey"), "reordered": base.select(*names[::-1]),
        "text": base.withColumn("o_totalprice", F.col("o_totalprice").cast("string"))}

    def loads(df: DataFrame) -> bool:
        try:
            rules.require_columns(df, names, exact=True)
            rules.require_same_features(base, df)
            rules.require_numeric(df, names)
        except ValueError:
            return False
        return True

    parts = []
    for name, df in variants.items():
        if loads(df):
            counts = F.count("o_totalprice").alias("checked_rows"), F.count_if(rules.not_finite(*names)).alias("not_finite")
            parts.append(df.agg(*counts).select(F.lit(name).alias("variant"), F.lit(True).alias("loads"), "checked_rows", "not_finite"))
        else:
            parts.append(spark.createDataFrame([(name, False, 0, 0)], "variant string, loads boolean, checked_rows long, not_finite long"))
    return reduce(DataFrame.unionByName, parts)
