"""Queries of effect summaries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import contrasts, summaries
from tidewater.plans.catalogue import _r, query
from tidewater.plans.evaluation import KEYS, WORLDS, _worlds
from tidewater.sources import canonical
from tidewater.sources.canonical import DAY

LEVELS = [8.0, 4.0, 2.0]
EFFECTS = WORLDS + """, e AS (SELECT family, kind, block, reference - history AS d FROM wide),
c AS (SELECT family, kind, count(d) AS size, count(DISTINCT round(d, 6)) AS n_values, stddev_samp(d) AS sd, avg((d > 0)::INT) AS positive, avg((d < 0)::INT) AS negative, min(d) AS low, max(d) AS high, max(d) - min(d) AS spread FROM e GROUP BY ALL)"""


def _effects(spark, sf_dir):
    w = contrasts.wide(_worlds(spark, sf_dir), KEYS, "policy", "burden", ["reference", "history"])
    return w.select(*KEYS, (F.col("reference") - F.col("history")).alias("d"))


def _rounded(df, names):
    return df.select(*(_r(c, c) if c in names else c for c in df.columns))


@query(EFFECTS + """ SELECT family, kind, size, n_values, round(sd, 6) AS sd, round(positive, 6) AS positive, round(negative, 6) AS negative, round(low, 6) AS low, round(high, 6) AS high, round(spread, 6) AS spread FROM c""")
def agg_context_spread(spark, sf_dir):
    """AGG-37, AGG-48: how far the effects of a context differ."""
    return _rounded(summaries.spread(_effects(spark, sf_dir), ["family", "kind"], "d"), ["sd", "positive", "negative", "low", "high", "spread"])


@query(EFFECTS + """, g AS (SELECT family, count(*) AS contexts, avg((spread > 20)::INT) AS varying, count(DISTINCT CASE WHEN spread > 20 THEN kind END) AS anchors, bool_or(spread > 20) AS any_varies,
  median(spread) AS median_spread, avg(CASE WHEN spread > 20 THEN spread END) AS mean_spread_varying FROM c GROUP BY family)
SELECT family, contexts, round(varying, 6) AS varying, anchors, any_varies, round(median_spread, 6) AS median_spread, round(mean_spread_varying, 6) AS mean_spread_varying, varying >= 0.5 AND anchors >= 2 AS qualifies FROM g""")
def agg_family_gates(spark, sf_dir):
    """AGG-38 to AGG-41: contexts that vary, by family, against a gate."""
    c = summaries.spread(_effects(spark, sf_dir), ["family", "kind"], "d")
    return _rounded(summaries.gates(c, ["family"], "kind", F.col("spread") > 20, 0.5, 2), ["varying", "median_spread", "mean_spread_varying"])


@query(WORLDS + """ SELECT family, kind, block, round(reference - history, 6) AS first_alone, round(reference - random, 6) AS second_alone, round(reference - ring, 6) AS together, round(history + random - reference - ring, 6) AS interaction FROM wide""")
def agg_lever_contrasts(spark, sf_dir):
    """AGG-54: two levers, each alone and both."""
    x = summaries.levers(_worlds(spark, sf_dir), KEYS, "policy", "burden", ["reference", "history", "random", "ring"])
    return _rounded(x, ["first_alone", "second_alone", "together", "interaction"])


@query(f"""+ l AS (SELECT unnest({LEVELS}) AS least, unnest([1, 2, 3]) AS level), f AS (SELECT source_id % 50 AS node, level, min(start) AS first_seen FROM dyads, l WHERE weight >= least GROUP BY ALL),
b AS (SELECT node, level, coalesce(first_seen <= lag(first_seen) OVER (PARTITION BY node ORDER BY level), true) AS held FROM f)
SELECT node, count(*) AS levels, bool_and(held) AS nested FROM b GROUP BY node""")
def agg_nested_detection(spark, sf_dir):
    """AGG-55: the first detection is never later at a more sensitive level."""
    d = canonical.dyads(spark, sf_dir)
    made = d.groupBy((F.col("source_id") % 50).alias("node")).agg(*(F.min(F.when(F.col("weight") >= t, F.col("start"))).alias(f"t{k}") for k, t in enumerate(LEVELS, 1)))
    long = made.select("node", F.posexplode(F.array(*(f"t{k}" for k in range(1, len(LEVELS) + 1)))).alias("level", "first_seen"))
    return summaries.nested(long, ["node"], "level", "first_seen")


@query("""+ p AS (SELECT event_id % 5 AS fold, kind, source_id / 150.0::DOUBLE AS chance, (weight > 5)::INT AS came, weight AS expected, source_id % 10 AS observed, CASE WHEN event_id % 5 = 4 THEN 0 ELSE target_id % 3 END AS w FROM dyads)
SELECT fold, kind, count(*) AS n, round(avg(pow(chance - came, 2)), 6) AS brier, round(CASE WHEN sum(w) > 0 THEN sum(w * abs(expected - observed)) / sum(w) ELSE avg(abs(expected - observed)) END, 6) AS error FROM p GROUP BY fold, kind""")
def agg_prediction_scores(spark, sf_dir):
    """AGG-57, AGG-58: Brier score and weighted error by fold; one fold has no weight at all."""
    d = canonical.dyads(spark, sf_dir).select(
        (F.col("event_id") % 5).alias("fold"), "kind", (F.col("source_id") / 150.0).alias("chance"), (F.col("weight") > 5).cast("int").alias("came"), F.col("weight").alias("expected"),
        (F.col("source_id") % 10).alias("observed"), F.when(F.col("event_id") % 5 == 4, 0).otherwise(F.col("target_id") % 3).alias("w"))
    return _rounded(summaries.prediction_scores(d, ["fold", "kind"], "chance", "came", "expected", "observed", "w"), ["brier", "error"])


@query(f"""+ m AS (SELECT source_id % 6 AS family, kind, start // {DAY} % 10 AS block, avg(weight) AS y FROM dyads GROUP BY ALL)
SELECT family, kind, count(*) AS points, round(regr_slope(y, block), 6) AS slope FROM m GROUP BY family, kind""")
def agg_curve_slopes(spark, sf_dir):
    """AGG-64: slope of each cluster's curve of means."""
    d = canonical.dyads(spark, sf_dir).select((F.col("source_id") % 6).alias("family"), "kind", (F.floor(F.col("start") / DAY) % 10).alias("block"), "weight")
    return _rounded(summaries.curve_slopes(d, ["family", "kind"], "block", "weight"), ["slope"])


@query("""+ g AS (SELECT kind, group_id, count(*) AS n, 3600 AS s FROM memberships GROUP BY ALL)
SELECT kind, sum(n)::BIGINT AS members, round(sum(s * n * (n - 1)) / sum(s * n), 6) AS competitors FROM g GROUP BY kind""")
def agg_member_competitors(spark, sf_dir):
    """AGG-50: mean competitors of a member over its time."""
    m = canonical.memberships(spark, sf_dir).withColumn("seconds", F.lit(3600))
    return _rounded(summaries.mean_competitors(m, ["kind"], "group_id", "seconds"), ["competitors"])


@query(EFFECTS + """, k AS (SELECT CASE WHEN family < 4 THEN family % 2 END AS modality, block % 2 AS half, kind, d FROM e WHERE d IS NOT NULL)
SELECT modality, half, count(d) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(min(d), 6) AS low, round(max(d), 6) AS high, count(*) FILTER (d > 0) AS above, count(*) FILTER (d < 0) AS below,
       string_agg(DISTINCT kind, ' | ' ORDER BY kind) AS sources FROM k GROUP BY modality, half""")
def agg_pooled_effects(spark, sf_dir):
    """AGG-33, AGG-34, AGG-56, AGG-60: effects pooled by modality, families without one under null."""
    e = _effects(spark, sf_dir).where("d is not null").select(F.when(F.col("family") < 4, F.col("family") % 2).alias("modality"), (F.col("block") % 2).alias("half"), "kind", "d")
    return _rounded(summaries.pooled(e, ["modality", "half"], "kind", "d"), ["mean", "median", "low", "high"])
