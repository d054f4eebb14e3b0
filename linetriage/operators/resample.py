"""Group bootstrap and the exact random-selection reference.

A draw is a multiplicity per group. Multinomial draws (each draw picks as many groups as
there are, with replacement) hash (seed, stratum, draw, slot) to a group number, so the
draws need no driver and give the same table in any engine with md5. Poisson(1) draws
need no shuffle at all and serve very large group counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linetriage.functions.columns import hash_number, hash_text, ratio
from linetriage.operators.budget import ALL
from linetriage.operators.draws import Picks, multinomial_picks as draws_of_groups, pack, tile_metrics
from linetriage.operators.ordering import Cuts, rank_by_hash
from linetriage.session import cut_lineage

DRAWS = 1000


def number_groups(df: DataFrame, strata: Sequence[str], group: str = "group_id") -> DataFrame:
    """Distinct groups with a number 0 .. G-1 inside their stratum, in hash order, and G."""
    groups = df.select(*strata, group).distinct().withColumn("_text", hash_text("boot", group))
    ranked = rank_by_hash(groups, list(strata), "_text", group, "_rank")
    return ranked.select(
        *strata, group, (F.col("_rank") - 1).alias("group_number"), F.col("_rank_total").alias("group_count")
    )


def multinomial_weights(
    df: DataFrame, draws: int, seed: int, strata: Sequence[str] = (), group: str = "group_id"
) -> DataFrame:
    """How often each group is drawn: strata, group, draw, w (only w >= 1)."""
    strata = list(strata)
    numbered = cut_lineage(number_groups(df, strata, group))
    # One hash text holds the picks of two draws: 15 hex digits from each half.
    pairs = numbered.withColumn("_pair", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 2)))).select(
        *strata, "_pair", "group_count", hash_text(seed, *strata, "_pair", "group_number").alias("_text")
    )
    halves = F.array(*[
        F.struct((F.col("_pair") * 2 + i).alias("draw"), hash_number(F.col("_text"), 15, 1 + 16 * i).alias("_pick"))
        for i in (0, 1)
    ])
    slots = pairs.select(*strata, "group_count", F.explode(halves).alias("_h")).where(F.col("_h.draw") < draws)
    picked = slots.select(
        *strata, "_h.draw", F.pmod("_h._pick", "group_count").alias("group_number")
    ).groupBy(*strata, "draw", "group_number").agg(F.count(F.lit(1)).alias("w"))
    return picked.join(numbered, [*strata, "group_number"]).select(*strata, group, "draw", "w")


def multinomial_picks(
    df: DataFrame, draws: int, seed: int, strata: Sequence[str] = (), group: str = "group_id", observed: bool = False
) -> Picks:
    """The draws of ``multinomial_weights``, packed; with ``observed`` also draw -1, in which every group counts once."""
    numbered = cut_lineage(number_groups(df, list(strata), group))
    return draws_of_groups(numbered, draws, seed, strata, group, observed)


def poisson_weights(
    df: DataFrame, draws: int, seed: int, strata: Sequence[str] = (), group: str = "group_id"
) -> DataFrame:
    """Independent Poisson(1) multiplicities from a hash: the large-scale stand-in for multinomial draws."""
    slots = df.select(*strata, group).distinct().withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    )
    uniform = hash_number(hash_text(seed, *strata, "draw", group)) / F.lit(float(16**15))
    w, below = F.lit(0), 0.0
    for i in range(18):
        below += math.exp(-1.0) / math.factorial(i)
        w = F.when(uniform >= below, F.lit(i + 1)).otherwise(w)
    return slots.withColumn("w", w.cast("long")).where(F.col("w") > 0)


def _vector_sums(df: DataFrame, keys: Sequence[str], name: str, length: int) -> DataFrame:
    """Sums of vectors by place, as plain sums of columns: these are hashed, while aggregates of objects are sorted."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.col(name)[i]).alias(f"_{i}") for i in range(length)])
    return sums.select(*keys, F.array(*[f"_{i}" for i in range(length)]).alias(name))


def draw_metrics(
    df: DataFrame, weights: DataFrame | Picks, dims: Sequence[str], fractions: Sequence[float],
    strata: Sequence[str] = (), scopes: Sequence[str] = (ALL,), cuts: Cuts | None = None,
) -> DataFrame:
    """Average precision and rows caught by a budget in every draw, ranked again inside the draw.

    ``scopes`` is ("all",) or ("all", "segment"). ``weights`` has a row per (strata, group, draw) at most, or comes packed
    from ``multinomial_picks``. The rows are cut into buckets of their order; a bucket gets its rows and the weights of its
    groups, and takes the sums of the buckets before it from counts per (bucket, group). A row with weight w counts as w
    copies that stand together.
    """
    link = [*strata, "group_id"]
    picks = weights if isinstance(weights, Picks) else pack(weights, link)
    return tile_metrics(df, picks, dims, fractions, link, scopes, cuts)


def interval(df: DataFrame, keys: Sequence[str], value: Column, draws: int, *more: Column) -> DataFrame:
    """95% interval over draws; draws where the value is undefined are counted, not used."""
    return df.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.025)).alias("lower95"), F.percentile(value, F.lit(0.975)).alias("upper95"),
        F.count(value).alias("valid_repeats"), *more,
    ).withColumns({
        "invalid_repeats": F.lit(draws) - F.col("valid_repeats"), "requested_repeats": F.lit(draws).cast("long"),
    })


def bootstrap_quality(
    df: DataFrame, draws: int = DRAWS, seed: int = 0, dims: Sequence[str] = (), fractions: Sequence[float] = (0.1, 0.2)
) -> DataFrame:
    """Group bootstrap intervals of average precision and budget recall."""
    weights = multinomial_picks(df, draws, seed)
    per_draw = draw_metrics(df, weights, dims, fractions)
    metrics = F.array(
        F.struct(F.lit("average_precision").alias("metric"), F.col("average_precision").alias("v"),
                 (F.col("fraction") == fractions[0]).alias("use")),
        F.struct(F.concat(F.lit("recall_at_"), F.col("fraction").cast("string")).alias("metric"),
                 F.col("recall").alias("v"), F.lit(True).alias("use")),
    )
    long = per_draw.select(*dims, F.explode(metrics).alias("m")).select(*dims, "m.*").where("use")
    return interval(long, [*dims, "metric"], F.col("v"), draws)


def paired_loss_bootstrap(
    df: DataFrame, baseline: str, candidate: str, draws: int = DRAWS, seed: int = 0
) -> DataFrame:
    """Interval of a mean loss difference. The statistic is linear, so a draw needs one sum per group."""
    diff = F.pow(F.col(candidate) - F.col("label"), F.lit(2)) - F.pow(F.col(baseline) - F.col("label"), F.lit(2))
    sums = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(diff).alias("d"))
    weights = multinomial_weights(df, draws, seed)
    per_draw = sums.join(weights, "group_id").groupBy("draw").agg(
        ratio(F.sum(F.col("d") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("v")
    )
    observed = df.agg(F.avg(diff).alias("difference"))
    spread = interval(per_draw.withColumn("_k", F.lit(1)), ["_k"], F.col("v"), draws)
    return spread.join(F.broadcast(observed.withColumn("_k", F.lit(1))), "_k").drop("_k")


def paired_policy_bootstrap(
    df: DataFrame, baseline: str, candidate: str, draws: int = DRAWS, seed: int = 0, fraction: float = 0.1,
    weights: DataFrame | None = None, dims: Sequence[str] = (),
) -> DataFrame:
    """Segment-stratified paired bootstrap: candidate minus baseline in recall and average precision.

    Budgets and ranks are made again in each draw, per segment (P_MACHINE) and pooled (P_GLOBAL). ``dims``
    (such as seed) keeps tables of scores apart; all of them get the same draws of groups.
    """
    dims = list(dims)
    pair = df.where(F.col("model").isin(baseline, candidate))
    # The observed table is one more draw, number -1, in which every group counts once.
    if weights is None:
        both = multinomial_picks(pair, draws, seed, ["segment"], observed=True)
    else:
        once = pair.select("segment", "group_id").distinct().withColumns({"draw": F.lit(-1), "w": F.lit(1).cast("long")})
        both = weights.select("segment", "group_id", "draw", "w").unionByName(once)
    per_draw = draw_metrics(pair, both, [*dims, "model"], [fraction], ["segment"], (ALL, "segment"))
    keys = [*dims, "segment", "policy", "metric"]
    deltas = _policy_values(per_draw, [*dims, "model", "draw"]).groupBy("draw", *keys).agg(
        (F.max(F.when(F.col("model") == candidate, F.col("v")))
         - F.max(F.when(F.col("model") == baseline, F.col("v")))).alias("delta")
    )
    drawn, observed = F.when(F.col("draw") >= 0, F.col("delta")), F.when(F.col("draw") < 0, F.col("delta"))
    return interval(deltas, keys, drawn, draws, F.max(observed).alias("difference"))


def _policy_values(per_draw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recall and average precision for each policy; the pooled per-segment budget adds up the segments."""
    pooled = F.col("scope") == ALL
    together = per_draw.groupBy(*keys).agg(
        F.sum(F.when(~pooled, F.col("found"))).alias("_segment_found"),
    )
    rows = per_draw.join(together, list(keys))
    per_segment = F.when(pooled, ratio(F.col("_segment_found"), F.col("positives"))).otherwise(F.col("recall"))
    values = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(m).alias("metric"), v.alias("v")) for p, m, v in (
            ("P_GLOBAL", "recall", F.col("recall")), ("P_MACHINE", "recall", per_segment),
            ("P_GLOBAL", "average_precision", F.col("average_precision")),
            ("P_MACHINE", "average_precision", F.col("average_precision")),
        )
    ])
    return rows.select(*keys, F.col("scope").alias("segment"), F.explode(values).alias("x")).select(
        *keys, "segment", "x.*"
    )


def random_reference(summary: DataFrame) -> DataFrame:
    """Exact distribution of positives caught when the budget picks rows at random.

    ``summary`` has segment, rows, positives, k, found. The hypergeometric weights come from
    running sums of log ratios; 40 deviations around the mean hold all mass a DOUBLE can show,
    so the table has about 80 * sqrt(rows) entries at most.
    """
    n, p, k = F.col("rows").cast("double"), F.col("positives"), F.col("k")
    share = F.col("positives") / n
    mean = F.col("k") * share
    deviation = F.sqrt(F.greatest(F.lit(0.0), mean * (1.0 - share) * (n - F.col("k")) / F.greatest(F.lit(1.0), n - 1.0)))
    low = F.greatest(F.greatest(F.lit(0), k + p - F.col("rows")), F.floor(mean - 40 * deviation) - 1)
    high = F.least(F.least(k, p), F.ceil(mean + 40 * deviation) + 1)
    spread = summary.withColumn("expected", mean).withColumn("i", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    i = F.col("i").cast("double")
    # ln(weight(i) / weight(i - 1))
    step = F.log((p - i + 1) * (k - i + 1) / (i * (n - p - k + i)))
    order = Window.partitionBy("segment").orderBy("i")
    first = F.row_number().over(order) == 1
    stepped = spread.withColumn("_s", F.when(first, 0.0).otherwise(step))
    logs = stepped.withColumn("_l", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("segment")
    masses = logs.withColumn("_m", F.exp(F.col("_l") - F.max("_l").over(whole)))
    probs = masses.withColumn("_p", F.col("_m") / F.sum("_m").over(whole))
    cdf = probs.withColumn("_c", F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cdf.groupBy("segment", "rows", "positives", "k", "found").agg(
        F.max("expected").alias("random_expected_found"),
        F.min(F.when(F.col("_c") >= 0.025, F.col("i"))).alias("random_lower95"),
        F.min(F.when(F.col("_c") >= 0.975, F.col("i"))).alias("random_upper95"),
        F.coalesce(F.sum(F.when(F.col("i") >= F.col("found"), F.col("_p"))), F.lit(0.0)).alias("random_ge_observed"),
    )
