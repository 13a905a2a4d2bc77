"""Queries of decision gates and of evaluation windows, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import gates, intervals, windows
from tidewater.plans.catalogue import DAY, ORIGIN, WEEK, _r, query
from tidewater.plans.fits import bootstrap_ctes
from tidewater.sources import canonical

CONTRASTS = ["sentinel", "separation", "response"]
RULES = [("role_separated", CONTRASTS), ("shared_list_sufficient", ["sentinel", "response"]), ("surveillance_helpful", ["sentinel"])]
OTHERWISE = "retain_or_abstain"
REPLICATES, SEED = 30, 7
EFFECTS = f"""+ effects AS (
  SELECT kind, ['{"', '".join(CONTRASTS)}'][1 + event_id % 3] AS contrast, source_id % 5 AS family, source_id AS unit, CASE WHEN event_id // 3 % 2 = 0 THEN weight ELSE -weight END + (event_id % 3) * 4 AS v FROM dyads)"""
GATE = f"""level_of AS (SELECT *, positive_share * families AS p, ceil(round(families * 0.8, 9))::INT AS required FROM boot),
gates AS (SELECT *, round(p)::INT AS positive, low > 0 AND round(p) >= required AS passes, CASE WHEN low > 0 AND round(p) >= required THEN 'strong' WHEN mean > 0 AND round(p) >= required THEN 'directional' ELSE 'unsupported' END AS level FROM level_of)"""
DECIDE = "CASE " + " ".join(f"WHEN {' AND '.join(f'bool_or(contrast = {c!r} AND passes)' for c in needed)} THEN '{name}'" for name, needed in RULES) + f" ELSE '{OTHERWISE}' END"
HELD = f"""{EFFECTS}, f AS (SELECT DISTINCT family AS held_out FROM effects), held AS (SELECT e.*, held_out FROM effects e JOIN f ON e.family <> f.held_out UNION ALL SELECT e.*, NULL FROM effects e)"""


def _effects(spark, sf_dir):
    i = F.col("event_id")
    return canonical.dyads(spark, sf_dir).select(
        "kind", F.get(F.array(*(F.lit(c) for c in CONTRASTS)), (i % 3).cast("int")).alias("contrast"), (F.col("source_id") % 5).alias("family"), F.col("source_id").alias("unit"),
        (F.when(F.floor(i / 3) % 2 == 0, F.col("weight")).otherwise(-F.col("weight")) + (i % 3) * 4).alias("v"))


@query(EFFECTS + bootstrap_ctes("effects", ["kind", "contrast"], ["family", "unit"], REPLICATES, SEED) + f", {GATE} SELECT kind, contrast, families, required, positive, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, passes, level FROM gates")
def gt_gates(spark, sf_dir):
    """GT-03, GT-08, GT-10, GT-19, GT-20, GT-24: levels of evidence of each contrast, by interval and agreement of families."""
    x = gates.gates(_effects(spark, sf_dir), ["kind"], "contrast", "family", "unit", "v", REPLICATES, SEED)
    return x.select("kind", "contrast", "families", "required", "positive", _r("mean", "mean"), _r("low", "low"), _r("high", "high"), "passes", "level")


def _held_gates(spark, sf_dir):
    return gates.gates(gates.without_each(_effects(spark, sf_dir), "family"), ["held_out", "kind"], "contrast", "family", "unit", "v", REPLICATES, SEED)


@query(HELD + bootstrap_ctes("held", ["held_out", "kind", "contrast"], ["family", "unit"], REPLICATES, SEED) + f""", {GATE}, d AS (SELECT held_out, kind, {DECIDE} AS decision FROM gates GROUP BY ALL),
w AS (SELECT kind, decision FROM d WHERE held_out IS NULL), r AS (SELECT d.kind, any_value(w.decision) AS decision, count(*) AS folds, count(*) FILTER (d.decision = w.decision) AS same FROM d JOIN w USING (kind) WHERE held_out IS NOT NULL GROUP BY d.kind)
SELECT kind, decision, folds, same, CASE WHEN same = folds THEN 'robust' WHEN same * 2 < folds THEN 'fragile' ELSE 'mixed' END AS status,
       CASE WHEN decision = '{OTHERWISE}' THEN 'abstain' WHEN decision = 'shared_list_sufficient' AND same = folds THEN 'robust_history' WHEN decision = 'shared_list_sufficient' THEN 'pooled_history_only' ELSE 'pooled_override_only' END AS evidence FROM r""")
def gt_leave_one_family_out(spark, sf_dir):
    """GT-01, GT-02, GT-06, GT-09, GT-12, GT-15, JN-22: decisions with each family left out, in one job, and what they say of the whole."""
    d = gates.decide(_held_gates(spark, sf_dir), ["held_out", "kind"], "contrast", RULES, OTHERWISE)
    r = gates.resilience(d, ["kind"], "held_out")
    e = gates.evidence_classes(r, r, ["kind"], OTHERWISE, "shared_list_sufficient").select("kind", "evidence")
    return r.join(e, "kind").select("kind", "decision", "folds", "same", "status", "evidence")


@query(HELD + bootstrap_ctes("held", ["held_out", "kind", "contrast"], ["family", "unit"], REPLICATES, SEED) + f""", {GATE}, cells AS (SELECT held_out, kind, count(*) FILTER (contrast IN ('sentinel', 'response')) AS n,
  min(CASE level WHEN 'unsupported' THEN 2 WHEN 'directional' THEN 3 ELSE 4 END) FILTER (contrast IN ('sentinel', 'response')) AS r FROM gates GROUP BY ALL)
SELECT coalesce(held_out, -1) AS held_out, sum(n)::BIGINT AS cells, CASE WHEN min(n) < 2 THEN 'incomplete' ELSE ['incomplete', 'unsupported', 'directional', 'strong'][min(r)] END AS level FROM cells GROUP BY ALL""")
def gt_joint_gate(spark, sf_dir):
    """GT-21 to GT-23: the weakest level over two contrasts in all kinds, with and without each family."""
    x = gates.joint(_held_gates(spark, sf_dir), ["held_out"], "kind", "contrast", ["sentinel", "response"])
    return x.select(F.coalesce("held_out", F.lit(-1)).alias("held_out"), "cells", "level")


@query(f"""+ l AS (SELECT kind, (start - {ORIGIN}) // {WEEK} AS week, CASE WHEN event_id % 2 = 0 THEN 'relative' ELSE 'absolute' END AS estimand, CASE WHEN event_id // 2 % 2 = 0 THEN weight ELSE -weight END + CASE WHEN event_id % 2 = 0 THEN 4 ELSE 8 END AS v FROM dyads),
s AS (SELECT kind, CASE WHEN week <> 2 THEN week END AS week, estimand, avg(v) AS mean, stddev_samp(v) / sqrt(count(*)) AS se FROM l GROUP BY ALL), m AS (SELECT *, mean - 1.96 * se AS low, mean + 1.96 * se AS high FROM s),
x AS (SELECT *, CASE WHEN low > 0 THEN 'supported_positive' WHEN high < 0 THEN 'supported_negative' WHEN mean > 0 THEN 'uncertain_positive' WHEN mean < 0 THEN 'uncertain_negative' ELSE 'zero' END AS status FROM m)
SELECT r.kind, r.week, round(r.mean, 6) AS relative_mean, round(a.mean, 6) AS absolute_mean, r.status AS relative_status, a.status AS absolute_status,
       CASE WHEN a.low > 0 AND r.low > 0 THEN 'direct_targeting_supported' WHEN a.low > 0 THEN 'additional_targeting_supported_policy_unresolved' ELSE 'abstain_or_require_external_calibration' END AS decision
FROM x r JOIN x a ON r.kind = a.kind AND r.week IS NOT DISTINCT FROM a.week AND r.estimand = 'relative' AND a.estimand = 'absolute'""")
def jn_safety_frontier(spark, sf_dir):
    """JN-21: relative and absolute effects of each setting side by side, with their statuses and a decision."""
    d = canonical.dyads(spark, sf_dir)
    i, week = F.col("event_id"), F.floor((F.col("start") - ORIGIN) / WEEK)
    v = F.when(F.floor(i / 2) % 2 == 0, F.col("weight")).otherwise(-F.col("weight")) + F.when(i % 2 == 0, 4).otherwise(8)
    s = d.groupBy("kind", F.when(week != 2, week).alias("week"), F.when(i % 2 == 0, "relative").otherwise("absolute").alias("estimand")).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("se"))
    ledger = s.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})
    x = gates.frontier(ledger, "estimand", ["kind", "week"])
    return x.select("kind", "week", _r("relative_mean", "relative_mean"), _r("absolute_mean", "absolute_mean"), "relative_status", "absolute_status", "decision")


SUPPORT = """ev AS (SELECT kind AS unit, event_id AS event, start, "end" FROM dyads WHERE source_id <> target_id), mem AS (SELECT event_id AS event, unnest([source_id, target_id]) AS node FROM dyads WHERE source_id <> target_id)"""
STANDING = """s AS (SELECT * FROM (SELECT a.unit, anchor, node, count(DISTINCT ev.event) AS support FROM anchors a JOIN ev ON ev.unit = a.unit AND start < anchor AND "end" > history_start AND "end" > start JOIN mem USING (event) GROUP BY ALL) WHERE support >= 3),
f AS (SELECT a.unit, a.anchor, ev.event, mem.node FROM anchors a JOIN ev ON ev.unit = a.unit AND start < horizon_end AND "end" > a.anchor AND "end" > start JOIN mem USING (event) JOIN s ON s.unit = a.unit AND s.anchor = a.anchor AND s.node = mem.node),
g AS (SELECT unit, anchor, event FROM f GROUP BY ALL HAVING count(*) > 1), t AS (SELECT unit, anchor, count(DISTINCT node) AS active, count(DISTINCT event) AS future_events FROM f JOIN g USING (unit, anchor, event) GROUP BY ALL HAVING count(DISTINCT node) > 1),
c AS (SELECT unit, anchor, count(*) AS eligible FROM s GROUP BY ALL HAVING count(*) > 1)
SELECT unit, history_start, anchor, horizon_end, (row_number() OVER (PARTITION BY unit ORDER BY anchor))::INT AS number, eligible, active, future_events FROM anchors JOIN c USING (unit, anchor) JOIN t USING (unit, anchor)"""


def _support(spark, sf_dir):
    d = canonical.dyads(spark, sf_dir).where("source_id <> target_id")
    return d.select(F.col("kind").alias("unit"), F.col("event_id").alias("event"), "start", "end"), d.select(F.col("event_id").alias("event"), F.explode(F.array("source_id", "target_id")).alias("node"))


@query(f"""+ {SUPPORT}, spans AS (SELECT unit, min(start) // {DAY} * {DAY} AS low, max("end") AS high FROM ev GROUP BY unit),
anchors AS (SELECT unit, unnest(range(low, high - {10 * DAY} + 1, {3 * DAY})) AS history_start, unnest(range(low + {WEEK}, high - {3 * DAY} + 1, {3 * DAY})) AS anchor, unnest(range(low + {10 * DAY}, high + 1, {3 * DAY})) AS horizon_end FROM spans WHERE high - low >= {10 * DAY}), {STANDING}""")
def int_supported_windows(spark, sf_dir):
    """INT-13, INT-14, INT-16 to INT-19: rolling windows that history and future support, with their eligible nodes."""
    events, members = _support(spark, sf_dir)
    spans = events.groupBy("unit").agg((F.floor(F.min("start") / DAY) * DAY).alias("low"), F.max("end").alias("high"))
    anchors = intervals.rolling_anchors(spans, WEEK, 3 * DAY, 3 * DAY).select("unit", "history_start", "anchor", "horizon_end")
    return windows.supported_windows(events, members, anchors, 3, DAY)[0]


@query(f"""+ {SUPPORT}, b AS (SELECT DISTINCT unit, start // {2 * DAY} * {2 * DAY} AS "at" FROM ev WHERE "end" > start AND start // {2 * DAY} % 3 <> 1), n AS (SELECT unit, "at", row_number() OVER (PARTITION BY unit ORDER BY "at") - 1 AS i, lag("at", 3) OVER (PARTITION BY unit ORDER BY "at") AS history_start FROM b),
anchors AS (SELECT unit, history_start, "at" AS anchor, "at" + {2 * DAY} AS horizon_end FROM n WHERE i IN (3, 5, 7)), {STANDING}""")
def int_block_windows(spark, sf_dir):
    """INT-15, INT-20: anchors at observed blocks after three earlier ones, of which some are never observed."""
    events, members = _support(spark, sf_dir)
    block = F.floor(F.col("start") / (2 * DAY))
    anchors = windows.block_anchors(events.where(block % 3 != 1), block * (2 * DAY), 2 * DAY, 3, [3, 5, 7])
    return windows.supported_windows(events, members, anchors.drop("index"), 3, DAY)[0]
