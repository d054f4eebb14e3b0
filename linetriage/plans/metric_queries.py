"""Metric queries over out-of-fold scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.operators import budget, groups, quality, quantiles
from linetriage.plans import views
from linetriage.plans.registry import query

DIMS = ["model", "seed"]
OOF = views.OOF


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c != "fraction"})


# Score table and its running sums for a relation s(keys..., score, label).
def _quality_sql(keys: str, source: str) -> str:
    return f"""st AS (SELECT {keys}, score, count(*) AS n, sum(label)::BIGINT AS pos FROM {source} GROUP BY {keys}, score),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp,
               sum(n) OVER (PARTITION BY {keys}) AS tn, sum(pos) OVER (PARTITION BY {keys}) AS tp
        FROM st WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
quality AS (SELECT {keys}, sum(pos * cp::DOUBLE / cn) / nullif(max(tp), 0) AS average_precision,
               1 - sum(pos::DOUBLE * ((cn - cp) - 0.5 * (n - pos))) / nullif((max(tp) * (max(tn) - max(tp)))::DOUBLE, 0)
               AS roc_auc FROM cum GROUP BY {keys})"""


AP_SQL = f"""WITH {OOF}, scoped AS (
  SELECT model, seed, score, label, unnest(['all', segment]) AS scope FROM oof), {_quality_sql('model, seed, scope', 'scoped')}
SELECT model, seed, scope AS segment, round({{metric}}, 6) AS {{metric}} FROM quality"""


def _by_scope(spark: SparkSession, sf: str) -> DataFrame:
    return budget.in_scopes(views.oof(spark, sf).select(*DIMS, "segment", "score", "label"), folds=False)


@query("A5 W8", AP_SQL.format(metric="average_precision"))
def ap(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.ranking_quality(_by_scope(spark, sf), [*DIMS, "scope"])
    return _rounded(out).select(*DIMS, F.col("scope").alias("segment"), "average_precision")


@query("A6", AP_SQL.format(metric="roc_auc"))
def auc(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.ranking_quality(_by_scope(spark, sf), [*DIMS, "scope"])
    return _rounded(out).select(*DIMS, F.col("scope").alias("segment"), "roc_auc")


GRID_SQL = f"""WITH {OOF}, scoped AS (
  SELECT o.*, s.scope, f.scope_fold FROM oof o, (SELECT unnest([0, 1]) AS a) x, (SELECT unnest([0, 1]) AS b) y,
  LATERAL (SELECT CASE WHEN a = 0 THEN 'all' ELSE o.segment END AS scope) s,
  LATERAL (SELECT CASE WHEN b = 0 THEN -1 ELSE o.fold END AS scope_fold) f {{folds}}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, seed, scope_fold, scope ORDER BY score DESC, segment, row_id) AS rg,
    count(*) OVER (PARTITION BY model, seed, scope_fold, scope) AS ng,
    row_number() OVER (PARTITION BY model, seed, scope_fold, scope, segment ORDER BY score DESC, row_id) AS rs,
    count(*) OVER (PARTITION BY model, seed, scope_fold, scope, segment) AS ns FROM scoped),
tested AS (
  SELECT r.*, p.policy, q.fraction, CASE WHEN p.policy = 'P_GLOBAL' THEN rg <= ceil(q.fraction * ng)
         ELSE rs <= ceil(q.fraction * ns) END AS selected
  FROM ranked r CROSS JOIN (VALUES {{policies}}) p(policy) CROSS JOIN (SELECT unnest({{fractions}}::DOUBLE[]) AS fraction) q),
picked AS (
  SELECT model, seed, scope_fold, scope, policy, fraction, count(*) AS rows, count(DISTINCT group_id) AS groups,
    sum(label)::BIGINT AS positives, count(*) FILTER (selected) AS k,
    coalesce(sum(label) FILTER (selected), 0)::BIGINT AS found FROM tested GROUP BY ALL),
{_quality_sql('model, seed, scope_fold, scope', 'scoped')},
grid AS (
  SELECT p.model, p.seed, CAST(p.scope_fold AS INTEGER) AS fold, p.scope AS segment, policy, fraction, rows, groups, positives, k, found,
    round(positives::DOUBLE / rows, 6) AS prevalence, positives - found AS missed, k - found AS selected_negative,
    round(found::DOUBLE / nullif(positives, 0), 6) AS recall, round(found::DOUBLE / nullif(k, 0), 6) AS "precision",
    round((found::DOUBLE * rows) / nullif(k::DOUBLE * positives, 0), 6) AS lift,
    round(average_precision, 6) AS average_precision, round(roc_auc, 6) AS roc_auc
  FROM picked p JOIN quality q ON p.model = q.model AND p.seed = q.seed AND p.scope_fold = q.scope_fold AND p.scope = q.scope)"""


@query("A9 A8", GRID_SQL.format(folds="", policies="('P_GLOBAL'), ('P_MACHINE')", fractions="[0.1, 0.2]")
       + " SELECT * FROM grid")
def comparison_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(budget.policy_table(views.oof(spark, sf), DIMS))


@query("A8 W7", GRID_SQL.format(folds="WHERE b = 0", policies="('P_MACHINE')", fractions="[0.1, 0.2]")
       + " SELECT * FROM grid")
def policy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(budget.policy_table(
        views.oof(spark, sf), DIMS, policies=(budget.PER_SEGMENT,), folds=False))


SWEEP = (0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2)


@query("A9 A13", GRID_SQL.format(folds="WHERE b = 0", policies="('P_MACHINE')", fractions=list(SWEEP)) + """
SELECT model, seed, segment, fraction, k, found AS tp, k - found AS fp, positives - found AS fn,
  rows - positives - (k - found) AS tn, round(2.0::DOUBLE * found / nullif(k + positives, 0), 6) AS f1,
  round((found + rows - positives - (k - found))::DOUBLE / rows, 6) AS accuracy FROM grid""")
def budget_sweep(spark: SparkSession, sf: str) -> DataFrame:
    table = budget.policy_table(
        views.oof(spark, sf), DIMS, SWEEP, (budget.PER_SEGMENT,), folds=False, group=None, quality=False)
    return _rounded(budget.derived_policy_metrics(table)).select(
        *DIMS, "segment", "fraction", "k", "tp", "fp", "fn", "tn", "f1", "accuracy")


@query("A7", GRID_SQL.format(folds="WHERE b = 0", policies="('P_GLOBAL')", fractions="[0.1, 0.2]") + """
SELECT model, seed, segment, fraction, rows, positives, k, found, prevalence, missed, selected_negative, recall,
  "precision", lift FROM grid""")
def topk_block(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(budget.top_block(views.oof(spark, sf), DIMS))


TIES_SQL = """t AS (SELECT *, row_number() OVER (PARTITION BY model, seed, scope ORDER BY score DESC, segment, row_id) AS r,
    count(*) OVER (PARTITION BY model, seed, scope) AS n FROM scoped),
e AS (SELECT model, seed, scope, fraction, score AS edge, r AS k FROM t CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) q(fraction)
      WHERE r = ceil(fraction * n)),
c AS (SELECT model, seed, scope, fraction, k, edge AS boundary_score, count(*) FILTER (score > edge) AS above_rows,
    coalesce(sum(label) FILTER (score > edge), 0)::BIGINT AS above_positives, count(*) FILTER (score = edge) AS tied_rows,
    sum(label) FILTER (score = edge)::BIGINT AS tied_positives, count(DISTINCT score) AS unique_scores
  FROM t JOIN e USING (model, seed, scope) GROUP BY ALL),
ties AS (SELECT model, seed, scope AS segment, fraction, k, round(boundary_score, 6) AS boundary_score, above_rows,
    above_positives, tied_rows, tied_positives, unique_scores, k - above_rows AS remaining,
    above_positives + greatest(0, (k - above_rows) - (tied_rows - tied_positives)) AS minimum_found,
    round(above_positives + (k - above_rows) * tied_positives / tied_rows::DOUBLE, 6) AS expected_found,
    above_positives + least(k - above_rows, tied_positives) AS maximum_found FROM c)"""


@query("A22", f"""WITH {OOF}, scoped AS (SELECT *, unnest(['all', segment]) AS scope FROM oof), {TIES_SQL} SELECT * FROM ties""")
def tie_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(budget.tie_bounds(views.oof(spark, sf), DIMS))


@query("A22 A13", f"""WITH {OOF}, scoped AS (SELECT *, segment AS scope FROM oof), {TIES_SQL}
SELECT model, seed, fraction, sum(minimum_found)::BIGINT AS tie_min_found, round(sum(expected_found), 4) AS tie_expected_found,
  sum(maximum_found)::BIGINT AS tie_max_found, sum(minimum_found) <> sum(maximum_found) AS tie_sensitive
FROM ties GROUP BY model, seed, fraction""")
def tie_totals(spark: SparkSession, sf: str) -> DataFrame:
    bounds = budget.tie_bounds(views.oof(spark, sf), DIMS, segments_only=True)
    return _rounded(budget.tie_totals(bounds, DIMS), 4)


@query("A10", f"""WITH {OOF}, p AS (SELECT *, greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score)) AS s FROM oof)
SELECT model, seed, segment, count(*) AS rows, round(avg((score - label) * (score - label)), 6) AS brier,
  round(avg(-(label * ln(s) + (1 - label) * ln(1 - s))), 6) AS log_loss, round(avg(score), 6) AS mean_probability,
  round(coalesce(2.0::DOUBLE * count(*) FILTER (score >= 0.5 AND label = 1)
    / nullif(count(*) FILTER (score >= 0.5) + sum(label), 0), 0), 6) AS f1_at_0_5
FROM p GROUP BY model, seed, segment""")
def prob_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(quality.probability_quality(views.oof(spark, sf), [*DIMS, "segment"]))


@query("A11 J2", f"""WITH {OOF}, b(bin, low, high) AS (VALUES (0, 0::DOUBLE, 0.01::DOUBLE), (1, 0.01, 0.02), (2, 0.02, 0.05),
  (3, 0.05, 0.1), (4, 0.1, 0.2), (5, 0.2, 0.5), (6, 0.5, 1.0)),
f AS (SELECT DISTINCT model, seed, segment FROM oof)
SELECT f.model, f.seed, f.segment, b.bin, b.low, b.high, count(o.score) AS rows, coalesce(sum(o.label), 0)::BIGINT AS label1,
  round(avg(o.score), 6) AS mean_probability, round(avg(o.label), 6) AS observed_rate
FROM f CROSS JOIN b LEFT JOIN oof o ON o.model = f.model AND o.seed = f.seed AND o.segment = f.segment
  AND o.score >= b.low AND (o.score < b.high OR b.bin = 6) GROUP BY ALL""")
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.reliability(views.oof(spark, sf), [*DIMS, "segment"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_probability", "observed_rate")})


@query("A12", f"""WITH {OOF}, c AS (SELECT model, seed, segment, count(*) AS rows, sum(label)::BIGINT AS positives,
  count(*) FILTER (score >= 0.7) AS k, count(*) FILTER (label = 1 AND score >= 0.7) AS tp,
  count(*) FILTER (label = 0 AND score >= 0.7) AS fp, count(*) FILTER (label = 1 AND score < 0.7) AS fn,
  count(*) FILTER (label = 0 AND score < 0.7) AS tn FROM oof GROUP BY ALL)
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS "precision",
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((tp + tn)::DOUBLE / rows, 6) AS accuracy FROM c""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.oof(spark, sf).withColumn("decision", F.col("score") >= 0.7)
    return _rounded(quality.confusion(rows, [*DIMS, "segment"]))


BANDED_SQL = f"""WITH {views.OBS}, med AS (
  SELECT f.fold AS fold, segment, quantile_cont(value, 0.5) AS mv, quantile_cont(user_id::DOUBLE, 0.5) AS mu
  FROM obs o JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f ON o.fold <> f.fold GROUP BY f.fold, segment),
banded AS (SELECT o.*, CASE WHEN value <= mv THEN 'le_train_median' ELSE 'gt_train_median' END AS band_value,
  CASE WHEN user_id <= mu THEN 'le_train_median' ELSE 'gt_train_median' END AS band_user_id, mv, mu,
  score >= 0.6 AS alert FROM obs o JOIN med m ON o.fold = m.fold AND o.segment = m.segment)"""


def banded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from linetriage.operators.derive import condition_bands

    rows = views.observations(spark, sf)
    medians = quantiles.training_medians(rows, ["value", "user_id"], range(5))
    out = condition_bands(rows, medians, ["value", "user_id"]).withColumn("alert", F.col("score") >= 0.6)
    return out, medians


@query("P5", f"{BANDED_SQL} SELECT segment, row_id, band_value, band_user_id FROM banded")
def bands(spark: SparkSession, sf: str) -> DataFrame:
    return banded(spark, sf)[0].select("segment", "row_id", "band_value", "band_user_id")


@query("P5 A17", f"""{BANDED_SQL} SELECT fold, segment, 'value' AS feature, round(mv, 6) AS median FROM med
UNION ALL SELECT fold, segment, 'user_id', round(mu, 6) FROM med""")
def training_medians(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(banded(spark, sf)[1])


@query("A14", f"""{BANDED_SQL}, s AS (
  SELECT segment, 'value' AS condition, band_value AS bands, label, alert, group_id FROM banded UNION ALL
  SELECT segment, 'user_id', CASE WHEN user_id % 10 = 0 THEN 'null' ELSE band_user_id END, label, alert, group_id FROM banded UNION ALL
  SELECT segment, 'joint', band_value || ' & ' || CASE WHEN user_id % 10 = 0 THEN 'null' ELSE band_user_id END, label, alert, group_id FROM banded),
c AS (SELECT segment, condition, bands, count(*) AS rows, count(DISTINCT group_id) AS feature_groups,
  count(*) FILTER (label = 1 AND alert) AS tp, count(*) FILTER (label = 1 AND NOT alert) AS fn,
  count(*) FILTER (label = 0 AND alert) AS fp, count(*) FILTER (label = 0 AND NOT alert) AS tn FROM s GROUP BY ALL)
SELECT *, tp + fn AS positive_rows, round(fn::DOUBLE / nullif(tp + fn, 0), 6) AS false_negative_rate,
  round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS false_positive_rate, tp + fn < 10 AS small_positive_sample FROM c""")
def error_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = banded(spark, sf)[0].withColumn("band_user_id", F.when(F.col("user_id") % 10 != 0, F.col("band_user_id")))
    conditions = {"value": ["band_value"], "user_id": ["band_user_id"], "joint": ["band_value", "band_user_id"]}
    return _rounded(quality.slices(rows, conditions))


@query("A15", f"""{BANDED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fold, segment ORDER BY score DESC, row_id)
    <= ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY fold, segment)) AS top FROM banded),
s AS (SELECT fold, segment, 'value' AS condition, band_value AS side, label, score, top FROM r UNION ALL
      SELECT fold, segment, 'user_id', band_user_id, label, score, top FROM r)
SELECT fold, segment, condition, side, count(*) AS rows, sum(label)::BIGINT AS label1, round(avg(score), 6) AS mean_score,
  count(*) FILTER (top) AS top10_count, count(*) FILTER (top AND label = 1) AS top10_true_positive,
  count(*) FILTER (top AND label = 0) AS top10_false_positive, count(*) FILTER (NOT top AND label = 1) AS top10_false_negative
FROM s GROUP BY ALL""")
def fold_condition_slices(spark: SparkSession, sf: str) -> DataFrame:
    top = budget.select(banded(spark, sf)[0], 0.1, dims=["fold"], out="top")
    return _rounded(quality.fold_slices(top, {"value": "band_value", "user_id": "band_user_id"}))


SELECTED = f"""WITH {OOF}, sel AS (SELECT *, row_number() OVER (PARTITION BY model, seed, segment ORDER BY score DESC, row_id)
    <= ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY model, seed, segment)) AS selected FROM oof)"""


@query("A16", f"""{SELECTED}, s AS (
  SELECT model, seed, segment, 'heavy_user' AS condition, CAST(user_id < 50 AS VARCHAR) AS value, label, selected, group_id FROM sel
  UNION ALL SELECT model, seed, segment, 'fold', CAST(fold AS VARCHAR), label, selected, group_id FROM sel)
SELECT model, seed, segment, condition, value, count(*) AS rows, count(DISTINCT group_id) AS groups, sum(label)::BIGINT AS positives,
  count(*) FILTER (selected) AS selected, count(*) FILTER (selected AND label = 1) AS found,
  count(*) FILTER (NOT selected AND label = 1) AS missed, count(*) FILTER (selected AND label = 0) AS selected_negative
FROM s GROUP BY ALL""")
def failure_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = budget.select(views.oof(spark, sf), 0.1, dims=DIMS).withColumn("heavy_user", F.col("user_id") < 50)
    return quality.selection_slices(rows, ["heavy_user", "fold"], DIMS)


@query("A17", f"""{SELECTED}, f AS (SELECT *, unnest([-1, fold]) AS scope_fold FROM sel)
SELECT model, seed, CAST(scope_fold AS INTEGER) AS fold, segment, count(*) AS rows, count(*) FILTER (selected) AS selected,
  count(*) FILTER (selected AND label = 1) AS found, count(*) FILTER (NOT selected AND label = 1) AS missed,
  round(quantile_cont(score, 0.1), 6) AS score_q10, round(quantile_cont(score, 0.5), 6) AS score_q50,
  round(quantile_cont(score, 0.9), 6) AS score_q90 FROM f GROUP BY ALL""")
def allocation(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.oof(spark, sf).select(*DIMS, "segment", "row_id", "fold", "label", "score")
    counts = quality.allocation(budget.select(rows, 0.1, dims=DIMS), DIMS)
    folds = rows.withColumn("fold", F.explode(F.array(F.lit(-1), F.col("fold"))))
    scope = [*DIMS, "fold", "segment"]
    shares = {"score_q10": 0.1, "score_q50": 0.5, "score_q90": 0.9}
    spread = quantiles.quantiles(folds, scope, "score", list(shares.values())).groupBy(*scope).agg(*[
        F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(name) for name, s in shares.items()
    ])
    return _rounded(counts.join(spread, scope))


@query("A18 Q15", f"""{SELECTED}, g AS (SELECT model, seed, group_id, max(label) AS event, bool_or(selected) AS a,
  bool_and(selected) AS b, max(score) - min(score) AS spread FROM sel GROUP BY ALL)
SELECT model, seed, count(*) AS groups, count(*) FILTER (event = 1) AS positive_groups, count(*) FILTER (a) AS groups_with_any_selected,
  count(*) FILTER (event = 1 AND a) AS positive_groups_with_any_selected,
  count(*) FILTER (event = 1 AND b) AS positive_groups_with_all_selected, round(max(spread), 6) AS largest_score_spread
FROM g GROUP BY model, seed""")
def group_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(groups.group_rollup(budget.select(views.oof(spark, sf), 0.1, dims=DIMS), DIMS))


@query("A19 A20", f"""WITH {OOF}, scoped AS (SELECT model, seed, score, label, segment AS scope FROM oof),
{_quality_sql('model, seed, scope', 'scoped')}
SELECT model, scope AS segment, round(avg(average_precision), 6) AS average_precision_mean,
  round(stddev_samp(average_precision), 6) AS average_precision_std, round(min(average_precision), 6) AS average_precision_min,
  round(max(average_precision), 6) AS average_precision_max, round(avg(roc_auc), 6) AS roc_auc_mean,
  round(stddev_samp(roc_auc), 6) AS roc_auc_std, round(min(roc_auc), 6) AS roc_auc_min, round(max(roc_auc), 6) AS roc_auc_max
FROM quality GROUP BY model, scope""")
def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    per_seed = quality.ranking_quality(views.oof(spark, sf), [*DIMS, "segment"])
    return _rounded(quality.seed_spread(per_seed, ["model", "segment"], ["average_precision", "roc_auc"]))


@query("A21 M11", f"""WITH {OOF} SELECT segment, row_id, model, label, round(avg(score), 9) AS score FROM oof GROUP BY ALL""")
def seed_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.seed_mean(views.oof(spark, sf), ["segment", "row_id", "model", "label"])
    return _rounded(out, 9)


CURVE_SQL = f"""WITH {OOF}, {_quality_sql('model, seed', 'oof')},
points AS (SELECT model, seed, score, cn::BIGINT AS inspected, cp::BIGINT AS caught, cp::DOUBLE / cn AS "precision",
  cp::DOUBLE / nullif(tp, 0) AS recall, cn::DOUBLE / tn AS inspected_share FROM cum)"""


@query("A31 W8", CURVE_SQL + """ SELECT model, seed, round(score, 9) AS score, inspected, caught, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(inspected_share, 6) AS inspected_share FROM points""")
def gain_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.curve_points(views.oof(spark, sf), DIMS)
    return out.withColumns({
        "score": F.round("score", 9),
        **{c: F.round(c, 6) for c in ("precision", "recall", "inspected_share")},
    })


@query("A29", CURVE_SQL + """, f AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM points),
a AS (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY f1 DESC, recall DESC, "precision" DESC, score DESC) AS r FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY "precision" DESC, score DESC) AS r FROM f WHERE recall >= 0.95 - 1e-12)
SELECT a.model, a.seed, round(a.score, 6) AS f1_threshold, round(a.f1, 6) AS inner_f1, round(a.recall, 6) AS f1_recall,
  round(b.score, 6) AS high_recall_threshold, round(b."precision", 6) AS high_recall_precision
FROM a JOIN b ON a.model = b.model AND a.seed = b.seed WHERE a.r = 1 AND b.r = 1""")
def f1_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(quality.best_thresholds(views.oof(spark, sf), DIMS, 0.95))


@query("A30", CURVE_SQL + """, t AS (SELECT DISTINCT model, seed, threshold FROM (
    SELECT model, seed, unnest(quantile_cont(score, [i / 200.0 FOR i IN range(201)])) AS threshold FROM oof GROUP BY model, seed)),
m AS (SELECT t.model, t.seed, threshold, max(caught) AS tp, max(inspected) AS k FROM t JOIN points p
      ON p.model = t.model AND p.seed = t.seed AND p.score >= threshold GROUP BY ALL),
f AS (SELECT m.*, 5.0 * tp / (4 * p + k) AS f2 FROM m JOIN (SELECT model, seed, max(tp) AS p FROM cum GROUP BY ALL) USING (model, seed)),
r AS (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY round(f2, 12) DESC, threshold) AS i FROM f)
SELECT model, seed, round(threshold, 6) AS f2_threshold, round(f2, 6) AS f2, CAST(k AS BIGINT) AS inspected FROM r WHERE i = 1""")
def f2_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(quality.best_f2_threshold(views.oof(spark, sf), DIMS))


@query("A32", GRID_SQL.format(folds="WHERE b = 0 AND a = 0", policies="('P_MACHINE')", fractions=list(SWEEP)) + """,
c AS (SELECT model, seed, fraction, k, found, found::DOUBLE / positives AS rec FROM grid WHERE segment = 'all'),
run AS (SELECT fraction, bool_and(rec >= 0.05 AND found < 60) AS every_run FROM c GROUP BY fraction),
mean AS (SELECT fraction, avg(rec) >= 0.05 AND avg(found) < 60 AS mean_run FROM c GROUP BY fraction)
SELECT min(fraction) FILTER (every_run AND mean_run) AS recommended_fraction, count(*) AS fractions_tested
FROM run JOIN mean USING (fraction)""")
def budget_choice(spark: SparkSession, sf: str) -> DataFrame:
    table = budget.policy_table(
        views.oof(spark, sf), DIMS, SWEEP, (budget.PER_SEGMENT,), folds=False, group=None, quality=False)
    pooled = table.where(F.col("segment") == budget.ALL).select(*DIMS, "fraction", "k", "found", "recall")
    return budget.smallest_sufficient(pooled, DIMS, (F.col("recall") >= 0.05) & (F.col("found") < 60))


@query("A36", """WITH p AS (SELECT d.lang AS lang, l.quality AS truth, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS guess
  FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT truth AS class, count(*) FILTER (guess = truth)::DOUBLE / count(*) AS rec FROM p GROUP BY truth),
k AS (SELECT c.class, 2.0 * count(*) FILTER (truth = c.class AND guess = c.class)
     / (count(*) FILTER (truth = c.class) + count(*) FILTER (guess = c.class)) AS f FROM p CROSS JOIN (SELECT unnest([0, 1]) AS class) c GROUP BY c.class)
SELECT round((SELECT avg((truth = guess)::INT) FROM p), 6) AS accuracy, round((SELECT avg(rec) FROM c), 6) AS balanced_accuracy,
  round((SELECT avg(f) FROM k), 6) AS f1_macro""")
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.docs(spark, sf).join(views.doc_labels(spark, sf), "row_id").select(
        F.col("label").alias("truth"), F.when(F.col("x") > 600, 1).otherwise(0).alias("guess"))
    return _rounded(quality.class_metrics(rows, [], "truth", "guess"))


@query("A36", """WITH p AS (SELECT o_orderstatus AS segment, o_totalprice AS t, o_totalprice * 0.9 + 1000 AS g FROM orders)
SELECT segment, round(sqrt(avg((t - g) * (t - g))), 4) AS rmse, round(avg(abs(t - g)), 4) AS mae,
  round(1 - avg((t - g) * (t - g)) / var_pop(t), 4) AS r2 FROM p GROUP BY segment""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.timed(spark, sf).withColumn("guess", F.col("x") * 0.9 + 1000)
    return _rounded(quality.regression_metrics(rows, ["segment"], "x", "guess"), 4)
