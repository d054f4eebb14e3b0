"""Bootstrap and random-reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.operators import budget, resample
from linetriage.plans import views
from linetriage.plans.registry import query

DRAWS = 50
PAIRED_DRAWS = resample.DRAWS
SEED = 9


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _weights_sql(source: str, strata: str = "", draws: int = DRAWS) -> str:
    """Multinomial draws of the groups of ``source``, within segments when ``strata`` is 'segment'."""
    part = f"PARTITION BY {strata} " if strata else ""
    lead = f"{strata}, " if strata else ""
    text = f"{strata} || '|' || " if strata else ""
    on = " AND w0.segment = n.segment" if strata else ""
    return f"""numbered AS (SELECT {lead}group_id, row_number() OVER ({part}ORDER BY md5('boot|' || group_id), group_id) - 1 AS i,
    count(*) OVER ({part.strip()}) AS g FROM (SELECT DISTINCT {lead}group_id FROM {source})),
w0 AS (SELECT {lead}d.draw, CAST('0x' || substr(md5('{SEED}|' || {text}(d.draw // 2) || '|' || i), 1 + 16 * (d.draw % 2), 15) AS BIGINT) % g AS i, count(*) AS w
  FROM numbered CROSS JOIN (SELECT unnest(range({draws})) AS draw) d GROUP BY ALL),
weights AS (SELECT {'n.segment, ' if strata else ''}n.group_id, draw, w FROM w0 JOIN numbered n ON w0.i = n.i{on})"""


AP_OF_DRAWS = """st AS (SELECT {keys}, score, sum(w) AS n, sum(w * label) AS pos FROM drawn GROUP BY {keys}, score),
cum AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER (PARTITION BY {keys}) AS tp
  FROM st WINDOW o AS (PARTITION BY {keys} ORDER BY score DESC)),
ap AS (SELECT {keys}, sum(pos * cp::DOUBLE / cn) / nullif(max(tp), 0) AS ap FROM cum GROUP BY {keys}),
copies AS (SELECT *, sum(w) OVER o - w AS before, sum(w) OVER (PARTITION BY {keys}) AS n, sum(w * label) OVER (PARTITION BY {keys}) AS p
  FROM drawn WINDOW o AS (PARTITION BY {keys} ORDER BY score DESC, segment, row_id))"""


@query("A25 X1 A5", f"""WITH {views.OBS}, {_weights_sql('obs')}, drawn AS (SELECT o.*, draw, w FROM obs o JOIN weights USING (group_id)),
{AP_OF_DRAWS.format(keys='draw')},
rec AS (SELECT draw, fraction, sum(label * least(w, greatest(0, greatest(1, ceil(fraction * n)) - before))) / nullif(max(p), 0)::DOUBLE AS r
  FROM copies CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) f(fraction) GROUP BY draw, fraction),
m AS (SELECT 'average_precision' AS metric, ap AS v FROM ap UNION ALL SELECT 'recall_at_' || fraction, r FROM rec)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS lower95, round(quantile_cont(v, 0.975), 6) AS upper95, count(v) AS valid_repeats,
  {DRAWS} - count(v) AS invalid_repeats, {DRAWS}::BIGINT AS requested_repeats FROM m GROUP BY metric""")
def boot_ap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(resample.bootstrap_quality(views.observations(spark, sf), DRAWS, SEED))


@query("A26 X1", f"""WITH {views.OBS}, {_weights_sql('obs')}, e AS (
  SELECT group_id, (score * 0.1 - label) * (score * 0.1 - label) - (0.05 - label) * (0.05 - label) AS d FROM obs),
v AS (SELECT draw, sum(d * w) / sum(w) AS v FROM e JOIN weights USING (group_id) GROUP BY draw)
SELECT round(quantile_cont(v, 0.025), 6) AS lower95, round(quantile_cont(v, 0.975), 6) AS upper95, count(v) AS valid_repeats,
  {DRAWS} - count(v) AS invalid_repeats, {DRAWS}::BIGINT AS requested_repeats, round((SELECT avg(d) FROM e), 6) AS difference FROM v""")
def boot_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.observations(spark, sf).withColumns({"candidate": F.col("score") * 0.1, "baseline": F.lit(0.05)})
    return _rounded(resample.paired_loss_bootstrap(rows, "baseline", "candidate", DRAWS, SEED))


PAIRED = """{ap}, rec AS (SELECT seed, model, draw, scope, sum(label * least(w, greatest(0, ceil(0.1::DOUBLE * n) - before))) AS found,
  max(p) AS p, any_value(ap) AS ap FROM copies JOIN ap USING (seed, model, draw, scope) GROUP BY seed, model, draw, scope),
tot AS (SELECT seed, model, draw, sum(found) AS f FROM rec WHERE scope <> 'all' GROUP BY seed, model, draw),
vals AS (
  SELECT seed, model, draw, scope, 'P_GLOBAL' AS policy, 'recall' AS metric, found / nullif(p, 0)::DOUBLE AS v FROM rec UNION ALL
  SELECT seed, model, draw, scope, 'P_MACHINE', 'recall', CASE WHEN scope = 'all' THEN f ELSE found END / nullif(p, 0)::DOUBLE FROM rec JOIN tot USING (seed, model, draw) UNION ALL
  SELECT seed, model, draw, scope, unnest(['P_GLOBAL', 'P_MACHINE']), 'average_precision', ap FROM rec),
delta AS (SELECT seed, draw, scope, policy, metric, max(v) FILTER (model = 'mixed') - max(v) FILTER (model = 'ratio') AS d FROM vals GROUP BY ALL)"""


@query("A27 X1 A8", f"""WITH {views.OOF}, pair AS (SELECT * FROM oof), {_weights_sql('pair', 'segment', PAIRED_DRAWS)},
all_weights AS (SELECT segment, group_id, draw, w FROM weights UNION ALL
  SELECT DISTINCT segment, group_id, -1, 1 FROM pair),
drawn AS (SELECT o.*, draw, w, unnest(['all', o.segment]) AS scope FROM pair o JOIN all_weights a ON a.segment = o.segment AND a.group_id = o.group_id),
{PAIRED.format(ap=AP_OF_DRAWS.format(keys='seed, model, draw, scope'))}
SELECT seed, scope AS segment, policy, metric, round(quantile_cont(d, 0.025) FILTER (draw >= 0), 6) AS lower95,
  round(quantile_cont(d, 0.975) FILTER (draw >= 0), 6) AS upper95, count(d) FILTER (draw >= 0) AS valid_repeats,
  {PAIRED_DRAWS} - count(d) FILTER (draw >= 0) AS invalid_repeats, {PAIRED_DRAWS}::BIGINT AS requested_repeats,
  round(max(d) FILTER (draw = -1), 6) AS difference
FROM delta GROUP BY seed, scope, policy, metric""")
def boot_paired(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(resample.paired_policy_bootstrap(views.oof(spark, sf), "ratio", "mixed", PAIRED_DRAWS, SEED, dims=["seed"]))


@query("A28", f"""WITH {views.OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS i,
  count(*) OVER (PARTITION BY segment) AS n FROM obs),
s AS (SELECT segment, count(*) AS rows, sum(label)::BIGINT AS positives, max(ceil(0.1::DOUBLE * n))::BIGINT AS k,
  sum(label) FILTER (i <= ceil(0.1::DOUBLE * n))::BIGINT AS found FROM r GROUP BY segment),
d AS (SELECT s.*, unnest(range(greatest(0, k + positives - rows), least(k, positives) + 1)) AS x FROM s),
p AS (SELECT *, exp(lgamma(positives + 1) - lgamma(x + 1) - lgamma(positives - x + 1)
    + lgamma(rows - positives + 1) - lgamma(k - x + 1) - lgamma(rows - positives - k + x + 1)
    - lgamma(rows + 1) + lgamma(k + 1) + lgamma(rows - k + 1)) AS q FROM d),
c AS (SELECT *, sum(q) OVER (PARTITION BY segment ORDER BY x) AS cdf FROM p)
SELECT segment, rows, positives, k, found, round(k * positives::DOUBLE / rows, 6) AS random_expected_found,
  min(x) FILTER (cdf >= 0.025) AS random_lower95, min(x) FILTER (cdf >= 0.975) AS random_upper95,
  round(sum(q) FILTER (x >= found), 6) AS random_ge_observed FROM c GROUP BY segment, rows, positives, k, found""")
def hypergeom_ref(spark: SparkSession, sf: str) -> DataFrame:
    rows = budget.select(views.observations(spark, sf), 0.1)
    summary = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"),
        F.sum(F.col("selected").cast("int")).alias("k"),
        F.sum(F.when(F.col("selected"), F.col("label")).otherwise(0)).alias("found"),
    )
    return _rounded(resample.random_reference(summary))
