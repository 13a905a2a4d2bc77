"""Queries of policies, contrasts, reliability and contracts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators import contrasts, intervals, policies, statistics
from tidewater.plans.catalogue import FEATURES, ORIGIN, WEEK, WEEK_2, WEEK_3, _features, _r, query
from tidewater.plans.catalogue import PAIRS as PAIRS_SQL
from tidewater.sources import canonical, contract
from tidewater.sources.canonical import DAY, HOUR

ARMS = ["reference", "history", "random", "ring"]
WORLDS = f"""+ worlds AS (
  SELECT source_id % 6 AS family, kind, start // {DAY} % 10 AS block, ['reference', 'history', 'random', 'ring'][event_id % 4 + 1] AS policy, 50 + source_id % 6 AS population,
         avg(weight) AS burden, string_agg(DISTINCT (target_id % 12)::VARCHAR, '|') AS nodes FROM dyads GROUP BY ALL),
wide AS (
  SELECT family, kind, block, any_value(population) AS population, max(CASE WHEN policy = 'reference' THEN burden END) AS reference, max(CASE WHEN policy = 'history' THEN burden END) AS history,
         max(CASE WHEN policy = 'random' THEN burden END) AS random, max(CASE WHEN policy = 'ring' THEN burden END) AS ring FROM worlds GROUP BY family, kind, block)"""
KEYS = ["family", "kind", "block"]


def _worlds(spark, sf_dir):
    """Mean burden of each arm in each (family, kind, block): four arms dealt by event."""
    d = canonical.dyads(spark, sf_dir)
    arm = F.get(F.array(*(F.lit(a) for a in ARMS)), (F.col("event_id") % 4).cast("int"))
    return d.groupBy((F.col("source_id") % 6).alias("family"), "kind", (F.floor(F.col("start") / DAY) % 10).alias("block"), arm.alias("policy"), (50 + F.col("source_id") % 6).alias("population")).agg(
        F.avg("weight").alias("burden"), F.concat_ws("|", F.collect_set((F.col("target_id") % 12).cast("string"))).alias("nodes"))  # at most 12 nodes


@query(WORLDS + """ SELECT family, kind, block, contrast, round(difference, 9) AS difference FROM (
  SELECT family, kind, block, unnest(['history_gain', 'random_gain', 'ring_over_history']) AS contrast,
         unnest([(reference - history) / population, (reference - random) / population, (history - ring) / population]) AS difference FROM wide) WHERE difference IS NOT NULL""")
def pv_policy_contrasts(spark, sf_dir):
    """PV-01 to PV-03, PV-07 to PV-10, PV-14, PV-15, JN-15: named contrasts over the population."""
    named = {"history_gain": ("reference", "history"), "random_gain": ("reference", "random"), "ring_over_history": ("history", "ring")}
    x = contrasts.contrasts(_worlds(spark, sf_dir), [*KEYS, "population"], "policy", "burden", named, "population")
    return x.select(*KEYS, "contrast", _r("difference", "difference", 9))


@query(WORLDS + """ SELECT family, kind, block, round(reference - random, 9) AS capacity, round(random - history, 9) AS targeting, round(history - ring, 9) AS ring_step, round(reference - ring, 9) AS total,
round((reference - random) - (history - ring), 9) AS interaction FROM wide""")
def pv_path_parts(spark, sf_dir):
    """PV-04 to PV-06, PV-13, AGG-54: parts of a path of arms, their total and the second difference."""
    x = contrasts.path(_worlds(spark, sf_dir), KEYS, "policy", "burden", ["reference", "random", "history", "ring"])
    return x.select(*KEYS, _r("reference_to_random", "capacity", 9), _r("random_to_history", "targeting", 9), _r("history_to_ring", "ring_step", 9), _r("total", "total", 9), _r("interaction", "interaction", 9))


@query(WORLDS + """, n AS (
  SELECT family, kind, block, max(CASE WHEN policy = 'history' THEN nodes END) AS h, max(CASE WHEN policy = 'ring' THEN nodes END) AS r FROM worlds WHERE policy IN ('history', 'ring') GROUP BY ALL),
s AS (SELECT *, list_filter(list_distinct(string_split(coalesce(h, ''), '|')), lambda v: v <> '' AND v <> '0') AS a, list_filter(list_distinct(string_split(coalesce(r, ''), '|')), lambda v: v <> '' AND v <> '0') AS b FROM n),
u AS (SELECT *, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS o FROM s)
SELECT family, kind, block, i = o AS same, round(CASE WHEN o = 0 THEN 1 ELSE i / o END, 9) AS jaccard FROM u""")
def pv_set_geometry(spark, sf_dir):
    """PV-16, PV-17, JN-11, JN-14, SET-03: likeness of two arms' node sets without the index node."""
    n = _worlds(spark, sf_dir).where(F.col("policy").isin("history", "ring")).groupBy(*KEYS).agg(
        F.max(F.when(F.col("policy") == "history", F.col("nodes"))).alias("h"), F.max(F.when(F.col("policy") == "ring", F.col("nodes"))).alias("r"))
    same, jaccard = contrasts.set_geometry(F.col("h"), F.col("r"), F.lit("0"))
    return n.select(*KEYS, same.alias("same"), _r(jaccard, "jaccard", 9))


@query(WORLDS + """, m AS (SELECT kind, family, block % 2 AS evaluator, CASE WHEN family % 2 = block % 2 THEN 'matched' ELSE 'crossed' END AS side, reference - history AS d FROM wide WHERE reference - history IS NOT NULL)
SELECT kind, family, round(avg(CASE WHEN side = 'matched' THEN d END), 9) AS matched, round(avg(CASE WHEN side = 'crossed' THEN d END), 9) AS crossed,
       round(avg(CASE WHEN side = 'matched' THEN d END) - avg(CASE WHEN side = 'crossed' THEN d END), 9) AS transfer_loss FROM m GROUP BY ALL""")
def pv_matched_crossed(spark, sf_dir):
    """PV-11, PV-12: gains where the evaluating model is the planning one, and where it isn't."""
    w = contrasts.wide(_worlds(spark, sf_dir), KEYS, "policy", "burden", ["reference", "history"]).withColumn("d", F.col("reference") - F.col("history"))
    w = w.where("d is not null").withColumn("side", F.when(F.col("family") % 2 == F.col("block") % 2, "matched").otherwise("crossed"))
    x = contrasts.wide(w, ["kind", "family"], "side", "d", ["matched", "crossed"])
    return x.select("kind", "family", _r("matched", "matched", 9), _r("crossed", "crossed", 9), _r(F.col("matched") - F.col("crossed"), "transfer_loss", 9))


@query(WORLDS + """, f AS (SELECT kind, family, avg((reference - history) / population) AS v FROM wide WHERE reference - history IS NOT NULL GROUP BY ALL),
t AS (SELECT kind, sum(v) AS s, count(*) AS k FROM f GROUP BY kind),
x AS (SELECT kind, count(*) AS families, avg(v) AS mean, median(v) AS median, min(v) AS low, max(v) AS high, count(*) FILTER (v > 0) AS positive, count(*) FILTER (v < 0) AS negative,
             min((s - v) / (k - 1)) AS least_without_one, max((s - v) / (k - 1)) AS most_without_one FROM f JOIN t USING (kind) GROUP BY kind)
SELECT kind, families, round(mean, 9) AS mean, round(median, 9) AS median, round(low, 9) AS low, round(high, 9) AS high, positive, negative, round(least_without_one, 9) AS least_without_one, round(most_without_one, 9) AS most_without_one,
       round((SELECT sum(factorial((positive + negative)::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((positive + negative - i)::INT)::DOUBLE)) FROM (SELECT unnest(range(positive, positive + negative + 1)) AS i)) / pow(2, positive + negative), 9) AS p FROM x""")
def agg_family_contrast(spark, sf_dir):
    """AGG-21, AGG-24, AGG-31, AGG-33, AGG-52, AGG-53: family effects, their extremes without one family, the sign test."""
    c = contrasts.contrasts(_worlds(spark, sf_dir), [*KEYS, "population"], "policy", "burden", {"history_gain": ("reference", "history")}, "population")
    x = statistics.family_summary(c, "family", "difference", ["kind"])
    return x.select("kind", "families", "positive", "negative", *(_r(n, n, 9) for n in ("mean", "median", "low", "high", "least_without_one", "most_without_one", "p")))


@query(WORLDS + """, c AS (SELECT kind, family, policy, avg(burden) AS loss, CASE policy WHEN 'reference' THEN 0 WHEN 'random' THEN 1 WHEN 'history' THEN 2 ELSE 3 END AS cost FROM worlds GROUP BY ALL),
b AS (SELECT kind, family, min(loss) AS best, max(CASE WHEN policy = 'reference' THEN loss END) AS ref FROM c GROUP BY ALL),
x AS (SELECT c.kind, h.family AS held_out, policy, cost, avg(ref - loss) AS mean_improvement, min(ref - loss) AS least_improvement, max(loss - best) AS most_regret
      FROM c JOIN b USING (kind, family) JOIN (SELECT DISTINCT kind, family FROM c) h ON h.kind = c.kind AND h.family <> c.family GROUP BY ALL),
s AS (SELECT unnest(['mean', 'maximin', 'regret']) AS selector),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, held_out, selector ORDER BY CASE selector WHEN 'mean' THEN -round(mean_improvement, 12) WHEN 'maximin' THEN -round(least_improvement, 12) ELSE round(most_regret, 12) END,
        CASE selector WHEN 'mean' THEN -round(least_improvement, 12) ELSE -round(mean_improvement, 12) END, cost, policy) AS p FROM x, s)
SELECT kind, held_out, selector, policy, round(mean_improvement, 9) AS mean_improvement, round(least_improvement, 9) AS least_improvement, round(most_regret, 9) AS most_regret FROM r WHERE p = 1""")
def rk_leave_one_family_out(spark, sf_dir):
    """RK-24 to RK-30: policies chosen on all other families by mean, maximin and minimax regret."""
    cost = F.when(F.col("policy") == "reference", 0).when(F.col("policy") == "random", 1).when(F.col("policy") == "history", 2).otherwise(3)
    c = _worlds(spark, sf_dir).groupBy("kind", "family", "policy").agg(F.avg("burden").alias("loss")).withColumn("cost", cost)
    out = None
    for s in ("mean", "maximin", "regret"):
        x = contrasts.leave_one_out_choice(c, ["kind"], "family", "policy", "loss", "cost", "reference", s).withColumn("selector", F.lit(s))
        out = x if out is None else out.unionByName(x)
    return out.select("kind", "held_out", "selector", "policy", *(_r(n, n, 9) for n in ("mean_improvement", "least_improvement", "most_regret")))


SCORED = FEATURES + """, scored AS (SELECT "window", node, round(contact_seconds, 3) AS v, activity_count::DOUBLE AS activity, observed_partners::DOUBLE AS partners, 1.0::DOUBLE AS constant FROM features)"""


def _scored(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("window", "node", F.round("contact_seconds", 3).alias("v"), F.col("activity_count").cast("double").alias("activity"), F.col("observed_partners").cast("double").alias("partners"), F.lit(1.0).alias("constant"))


@query(SCORED + """, size AS (SELECT "window", count(*) AS n, avg(v) AS random_value, greatest(1, ceil(count(*) * 0.2::DOUBLE))::INT AS k FROM scored GROUP BY ALL),
vg AS (SELECT "window", v, count(*) AS c FROM scored GROUP BY ALL),
vf AS (SELECT "window", v, c, k, least(1, greatest(0, (k - coalesce(sum(c) OVER (PARTITION BY "window" ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / c)) AS o FROM vg JOIN size USING ("window")),
best AS (SELECT "window", sum(o * c * v) / max(k) AS oracle_value FROM vf GROUP BY "window"),
long AS (SELECT "window", v, o, unnest(['activity', 'partners', 'constant', 'random']) AS method, unnest([activity, partners, constant, 0.0]) AS score FROM scored JOIN vf USING ("window", v)),
tied AS (SELECT "window", method, score, count(*) AS c, sum(v) AS v, sum(o) AS o FROM long GROUP BY ALL),
sf AS (SELECT t.*, k, least(1, greatest(0, (k - coalesce(sum(c) OVER (PARTITION BY "window", method ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / c)) AS f FROM tied t JOIN size USING ("window")),
m AS (SELECT "window", method, sum(f * v) / max(k) AS selected_value, sum(f * o) / max(k) AS overlap, count(*) AS n_scores FROM sf GROUP BY ALL),
rk AS (SELECT "window", method, rank() OVER (PARTITION BY "window", method ORDER BY score) + (count(*) OVER (PARTITION BY "window", method, score) - 1) / 2.0::DOUBLE AS a,
              rank() OVER (PARTITION BY "window", method ORDER BY v) + (count(*) OVER (PARTITION BY "window", method, v) - 1) / 2.0::DOUBLE AS b FROM long),
rho AS (SELECT "window", method, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) ELSE 0 END AS spearman FROM rk GROUP BY ALL)
SELECT "window", method, n, k, round(spearman, 9) AS spearman, n_scores, round(selected_value, 6) AS selected_value, round(oracle_value, 6) AS oracle_value, round(random_value, 6) AS random_value,
       round(CASE WHEN oracle_value - random_value > 1e-15 THEN (selected_value - random_value) / (oracle_value - random_value) END, 6) + 0.0::DOUBLE AS capture, round(oracle_value - selected_value, 6) AS regret, round(overlap, 6) AS overlap
FROM m JOIN size USING ("window") JOIN best USING ("window") JOIN rho USING ("window", method)""")
def rk_evaluate_scores(spark, sf_dir):
    """RK-01: what the best fifth by each score is worth, with ties shared."""
    x = policies.evaluate_scores(_scored(spark, sf_dir), ["window"], "v", ["activity", "partners", "constant", "random"], 0.2)
    return x.select("window", "method", "n", "k", "n_scores", _r("spearman", "spearman", 9), *(_r(n, n) for n in ("selected_value", "oracle_value", "random_value", "regret")), (F.round("capture", 6) + 0.0).alias("capture"), _r("overlap", "overlap"))


@query(SCORED + """, j AS (SELECT a."window" AS l, b."window" AS r, a.node AS item, a.v AS lv, b.v AS rv FROM scored a JOIN scored b ON a.node = b.node AND a."window" < b."window"),
kk AS (SELECT *, rank() OVER (PARTITION BY l, r ORDER BY lv) + (count(*) OVER (PARTITION BY l, r, lv) - 1) / 2.0::DOUBLE AS lr, rank() OVER (PARTITION BY l, r ORDER BY rv) + (count(*) OVER (PARTITION BY l, r, rv) - 1) / 2.0::DOUBLE AS rr,
       row_number() OVER (PARTITION BY l, r ORDER BY lv DESC, item) <= 10 AS lt, row_number() OVER (PARTITION BY l, r ORDER BY rv DESC, item) <= 10 AS rt FROM j),
x AS (SELECT l, r, count(*) AS shared, CASE WHEN min(lr) < max(lr) AND min(rr) < max(rr) THEN corr(lr, rr) END AS spearman, count(*) FILTER (lt AND rt) AS overlap, count(*) FILTER (lt OR rt) AS either,
             avg(lv) FILTER (lt) AS lb, avg(rv) FILTER (rt) AS rb, avg(rv) FILTER (lt) AS rl, avg(lv) FILTER (rt) AS ll FROM kk GROUP BY l, r HAVING count(*) >= 2)
SELECT l AS "left", r AS "right", shared, round(spearman, 9) AS spearman, least(10, shared)::INT AS k, overlap, round(overlap / least(10, shared), 9) AS overlap_fraction, round(overlap / either, 9) AS jaccard,
       round(CASE WHEN rb > 0 THEN rl / rb END, 6) AS left_to_right, round(CASE WHEN lb > 0 THEN ll / lb END, 6) AS right_to_left,
       round((CASE WHEN rb > 0 THEN rl / rb END + CASE WHEN lb > 0 THEN ll / lb END) / 2, 6) AS retention, round((rb - rl + lb - ll) / 2, 6) AS regret FROM x""")
def rk_pairwise_stability(spark, sf_dir):
    """RK-06, RK-08, JN-27: every two weeks compared on the nodes that both hold."""
    x = policies.rank_stability(_scored(spark, sf_dir), "window", "node", "v", 10)
    return x.select("left", "right", "shared", _r("spearman", "spearman", 9), "k", "overlap", _r("overlap_fraction", "overlap_fraction", 9), _r("jaccard", "jaccard", 9), *(_r(n, n) for n in ("left_to_right", "right_to_left", "retention")), _r("regret", "regret"))


@query(SCORED + """, p AS (SELECT *, (activity + partners) / 2 AS blend, sha256('7' || chr(31) || 'ties' || chr(31) || node) AS h FROM scored WHERE node % 9 <> 0),
kk AS (SELECT "window", node, unnest(['history', 'contact', 'blend', 'partners', 'random', 'inverse']) AS method, unnest([
  row_number() OVER (PARTITION BY "window" ORDER BY activity DESC, h, node), row_number() OVER (PARTITION BY "window" ORDER BY v DESC, h, node), row_number() OVER (PARTITION BY "window" ORDER BY blend DESC, h, node),
  row_number() OVER (PARTITION BY "window" ORDER BY partners DESC, v DESC, h, node), row_number() OVER (PARTITION BY "window" ORDER BY h, node), row_number() OVER (PARTITION BY "window" ORDER BY activity, h, node)]) AS position FROM p)
SELECT "window", method, node, position::INT AS position FROM kk WHERE position <= 8""")
def rk_select_targets(spark, sf_dir):
    """RK-07, RK-09, RK-10, RK-12 to RK-14, RK-16: targets of six policies among those not detected, ties by a keyed hash."""
    h = policies.hash_order(F.col("node"), 7, "ties")
    some = _scored(spark, sf_dir).where("node % 9 <> 0")
    orders = {
        "history": [F.desc("activity"), h], "contact": [F.desc("v"), h], "blend": [((F.col("activity") + F.col("partners")) / 2).desc(), h],
        "partners": [F.desc("partners"), F.desc("v"), h], "random": [h], "inverse": [F.asc("activity"), h]}
    return policies.targets(some, ["window"], "node", orders, 8).select("window", "method", "node", "position")


PRIOR = f"""+ weekly AS (SELECT kind, (start - {ORIGIN}) // {WEEK} AS week, source_id AS node, round(sum(weight), 3) AS v FROM dyads GROUP BY ALL),
scored AS (SELECT *, (rank() OVER (PARTITION BY kind, week ORDER BY v) + (count(*) OVER (PARTITION BY kind, week, v) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY kind, week) AS s FROM weekly)"""


def _weekly(spark, sf_dir):
    d = canonical.dyads(spark, sf_dir)
    w = d.groupBy("kind", F.floor((F.col("start") - ORIGIN) / WEEK).alias("week"), F.col("source_id").alias("node")).agg(F.round(F.sum("weight"), 3).alias("v"))
    return ranks.average_rank(w, "v", ["kind", "week"], "s", True)


@query(PRIOR + """, g AS (SELECT kind, week, sum(v) AS s, count(*) AS n FROM weekly GROUP BY ALL),
past AS (SELECT kind, week, sum(s) OVER w / sum(n) OVER w AS m FROM g WINDOW w AS (PARTITION BY kind ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT a.kind, a.week, a.node, avg(b.s) AS stable, avg(b.v) AS raw, max_by(b.s, b.week) AS last, count(b.s) AS n FROM scored a LEFT JOIN scored b ON a.kind = b.kind AND a.node = b.node AND b.week < a.week GROUP BY ALL)
SELECT kind, week, node, round(coalesce(stable, 0.5), 9) AS stable, round(coalesce(raw, m, 0), 6) AS raw, round(coalesce(last, 0.5), 9) AS last, n AS observations FROM x JOIN past USING (kind, week)""")
def rk_prior_history(spark, sf_dir):
    """RK-31, RK-32: what was known of each candidate strictly before each anchor."""
    x = policies.prior_history(_weekly(spark, sf_dir), ["kind"], "node", "week", "s", "v")
    return x.select("kind", "week", "node", _r("stable", "stable", 9), _r("raw", "raw"), _r("last", "last", 9), "observations")


@query(PRIOR + """, m AS (SELECT DISTINCT kind, week FROM weekly), c AS (SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY week DESC) AS back FROM m)
SELECT kind, week, back <= ceil(n * 0.3::DOUBLE) AND n - ceil(n * 0.3::DOUBLE) >= 2 AS test FROM c""")
def rk_chronological_split(spark, sf_dir):
    """RK-34, RK-36: the last anchors of each network are for tests."""
    return policies.chronological_test(_weekly(spark, sf_dir), ["kind"], "week", 0.3)


@query(PRIOR + """SELECT kind, week, round(max(v), 3) AS oracle, round(avg(v), 6) AS random, arg_max(node, {'v': v, 'n': -node}) AS oracle_node, arg_max(node, {'v': s, 'n': -node}) AS chosen, count(*) AS n,
round(max(v) - avg(v), 6) AS margin FROM scored GROUP BY ALL""".replace("PRIOR", ""))
def rk_decision_rows(spark, sf_dir):
    """RK-20, RK-21, RK-37, RK-38: the best candidate of each context by value and by score, and the mean of all."""
    w = _weekly(spark, sf_dir)
    return w.groupBy("kind", "week").agg(
        _r(F.max("v"), "oracle", 3), _r(F.avg("v"), "random"), F.max_by("node", F.struct("v", -F.col("node"))).alias("oracle_node"),
        F.max_by("node", F.struct("s", -F.col("node"))).alias("chosen"), F.count("*").alias("n"), _r(F.max("v") - F.avg("v"), "margin"))


@query(WORLDS + """, d AS (SELECT abs(reference - history) AS margin, round(reference - history, 9) AS gain FROM wide WHERE reference - history IS NOT NULL),
t AS (SELECT unnest([0, 25, 50, 100, 200, 400]::DOUBLE[]) AS threshold),
x AS (SELECT threshold, count(*) FILTER (margin >= threshold) AS overrides, coalesce(avg(gain) FILTER (margin >= threshold), 0) AS mean_gain FROM d, t GROUP BY threshold)
SELECT threshold, overrides, round(mean_gain, 6) AS mean_gain, threshold = coalesce((SELECT min(threshold) FROM x WHERE mean_gain >= 0 AND overrides > 0), 'inf'::DOUBLE) AS chosen FROM x""")
def rk_threshold(spark, sf_dir):
    """RK-39, RK-40: the least margin from which overriding pays."""
    w = contrasts.wide(_worlds(spark, sf_dir), KEYS, "policy", "burden", ["reference", "history"]).withColumn("g", F.col("reference") - F.col("history")).where("g is not null")
    x = policies.calibrated_threshold(w.select(F.abs("g").alias("margin"), F.round("g", 9).alias("gain")), "margin", "gain", [0, 25, 50, 100, 200, 400])
    return x.select("threshold", "overrides", _r("mean_gain", "mean_gain"), "chosen")


def _coverage_sql(budget: int) -> str:
    sql = PAIRS_SQL + ", w AS (SELECT a AS node, b AS partner, contact_seconds AS w FROM pairs UNION ALL SELECT b, a, contact_seconds FROM pairs), s0 AS (SELECT NULL::BIGINT AS node WHERE false)"
    for k in range(1, budget + 1):
        sql += f""", g{k} AS (
  SELECT n.node, coalesce(sum(greatest(0, w.w - coalesce(c.c, 0))), 0) AS gain FROM (SELECT DISTINCT node FROM w WHERE node NOT IN (FROM s{k - 1})) n
  LEFT JOIN (SELECT * FROM w WHERE partner NOT IN (FROM s{k - 1})) w ON w.node = n.node
  LEFT JOIN (SELECT partner, max(w) AS c FROM w WHERE node IN (FROM s{k - 1}) GROUP BY partner) c ON c.partner = w.partner GROUP BY n.node),
b{k} AS (SELECT node FROM g{k} ORDER BY -round(gain, 6), sha256('5' || chr(31) || 'history_coverage_ties' || chr(31) || node), node LIMIT 1), s{k} AS (FROM s{k - 1} UNION ALL FROM b{k})"""
    return sql + " ".join(f"{'UNION ALL' if k > 1 else ''} SELECT node, {k} AS position FROM b{k}" for k in range(1, budget + 1))


@query(_coverage_sql(3))
def rk_greedy_coverage(spark, sf_dir):
    """RK-15, AGG-03: nodes that in turn cover most of the others' contact."""
    return policies.group_coverage(canonical.memberships(spark, sf_dir), 3600.0, 3, 5)


@query(PRIOR + """, cells AS (SELECT kind, node, week, v FROM weekly), b AS (SELECT kind, count(DISTINCT week) AS blocks FROM cells GROUP BY kind),
i AS (SELECT kind, node, avg(v) AS m, var_samp(v) AS w, any_value(blocks) AS k FROM cells JOIN b USING (kind) GROUP BY kind, node HAVING count(*) = any_value(blocks) AND any_value(blocks) > 1),
x AS (SELECT kind, count(*) AS items, max(k) AS blocks, max(k) * var_samp(m) AS msb, avg(w) AS msw FROM i GROUP BY kind HAVING count(*) > 1)
SELECT kind, items, blocks, round(msb, 3) AS ms_between, round(msw, 3) AS ms_within, round((msb - msw) / (msb + (blocks - 1) * msw), 9) AS icc_single, round((msb - msw) / msb, 9) AS icc_mean,
       round(CASE WHEN (msb - msw) / (msb + (blocks - 1) * msw) <= 0 THEN 0 ELSE blocks * ((msb - msw) / (msb + (blocks - 1) * msw)) / (1 + (blocks - 1) * ((msb - msw) / (msb + (blocks - 1) * msw))) END, 9) AS reliability FROM x""")
def agg_block_reliability(spark, sf_dir):
    """AGG-13, AGG-16, AGG-17: mean squares between and within items, intra-class correlations, Spearman-Brown."""
    x = statistics.block_reliability(_weekly(spark, sf_dir), ["kind"], "node", "week", "v")
    return x.select("kind", "items", "blocks", _r("ms_between", "ms_between", 3), _r("ms_within", "ms_within", 3), _r("icc_single", "icc_single", 9), _r("icc_mean", "icc_mean", 9), _r(statistics.spearman_brown(F.col("icc_single"), F.col("blocks")), "reliability", 9))


@query(PRIOR + """, b AS (SELECT kind, week, row_number() OVER (PARTITION BY kind ORDER BY week) AS i FROM (SELECT DISTINCT kind, week FROM weekly)), w AS (SELECT * FROM weekly JOIN b USING (kind, week)),
l AS (SELECT w.*, b.i AS level FROM w JOIN b ON w.kind = b.kind AND w.i <= b.i), p AS (SELECT kind, level, node, avg(v) AS m FROM l GROUP BY ALL), f AS (SELECT kind, node, avg(v) AS final FROM w GROUP BY ALL)
SELECT kind, level, count(*) AS n, round(avg(abs(m - final)), 6) AS apart, round(max(abs(m - final)), 6) AS most FROM p JOIN f USING (kind, node) GROUP BY ALL""")
def agg_prefix_convergence(spark, sf_dir):
    """AGG-44 to AGG-46: means over the first blocks against those over all."""
    p = statistics.prefix_means(_weekly(spark, sf_dir), ["kind"], "node", "week", "v")
    apart = F.abs(F.col("m") - F.col("final"))
    return p.groupBy("kind", "level").agg(F.count("*").alias("n"), _r(F.avg(apart), "apart"), _r(F.max(apart), "most"))


@query(PRIOR + """, b AS (SELECT kind, week, row_number() OVER (PARTITION BY kind ORDER BY week) AS i, count(*) OVER (PARTITION BY kind) AS z FROM (SELECT DISTINCT kind, week FROM weekly)), w AS (SELECT weekly.*, i, z FROM weekly JOIN b USING (kind, week)),
n AS (SELECT kind, node, i, v, unnest(range(i, z + 1)) AS level FROM w), c AS (SELECT kind, level, node, avg(v) AS m, var_samp(v) AS s, count(*) AS c FROM n GROUP BY ALL),
x AS (SELECT kind, level, level * var_samp(m) AS msb, avg(s) AS msw FROM c WHERE c = level AND level > 1 GROUP BY kind, level HAVING count(*) > 1), icc AS (SELECT kind, level, (msb - msw) / (msb + (level - 1) * msw) AS r FROM x),
f AS (SELECT kind, node, avg(v) AS final FROM w GROUP BY ALL), j AS (SELECT c.kind, level, c.node, m, final FROM c JOIN f ON c.kind = f.kind AND c.node = f.node),
r AS (SELECT *, rank() OVER (PARTITION BY kind, level ORDER BY m) + (count(*) OVER (PARTITION BY kind, level, m) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY kind, level ORDER BY final) + (count(*) OVER (PARTITION BY kind, level, final) - 1) / 2.0::DOUBLE AS z,
  row_number() OVER (PARTITION BY kind, level ORDER BY m DESC, node) <= 10 AS ma, row_number() OVER (PARTITION BY kind, level ORDER BY final DESC, node) <= 10 AS fa FROM j),
g AS (SELECT kind, level, count(*) AS items, CASE WHEN min(a) < max(a) AND min(z) < max(z) THEN corr(a, z) END AS spearman, count(*) FILTER (ma AND fa) / count(*) FILTER (fa) AS top_overlap, avg((m = 0)::INT) AS zero_share FROM r GROUP BY ALL)
SELECT g.kind, g.level, items, round(CASE WHEN r <= 0 THEN 0 ELSE g.level * r / (1 + (g.level - 1) * r) END, 6) AS reliability, round(spearman, 6) + 0.0::DOUBLE AS spearman, round(top_overlap, 6) AS top_overlap, round(zero_share, 6) AS zero_share FROM g LEFT JOIN icc ON g.kind = icc.kind AND g.level = icc.level""")
def agg_precision_curve(spark, sf_dir):
    """AGG-45, AGG-46: reliability, order, best items and zeros of means over growing numbers of weeks."""
    x = statistics.precision_curve(_weekly(spark, sf_dir), ["kind"], "node", "week", "v", 10)
    return x.select("kind", "level", "items", *(_r(c, c) for c in ("reliability", "spearman", "top_overlap", "zero_share")))


@query(PRIOR + """, h AS (SELECT kind, node, avg(v) FILTER (week % 2 = 0) AS a, avg(v) FILTER (week % 2 = 1) AS b FROM weekly GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY a DESC, node) <= 10 AS ta, row_number() OVER (PARTITION BY kind ORDER BY b DESC, node) <= 10 AS tb, count(*) OVER (PARTITION BY kind) AS n FROM h WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT kind, max(n) AS n, count(*) FILTER (ta AND tb) AS overlap, round(least(10, max(n)) ** 2 / max(n), 9) AS chance, round(avg(b) FILTER (tb) - avg(b) FILTER (ta), 6) AS regret, count(*) FILTER (ta AND tb) > least(10, max(n)) ** 2 / max(n) AS reproducible FROM r GROUP BY kind""")
def agg_split_half(spark, sf_dir):
    """AGG-42, AGG-43: the best of one half of the blocks judged by the other half."""
    half = lambda k: F.avg(F.when(F.pmod("week", F.lit(2)) == k, F.col("v")))
    h = _weekly(spark, sf_dir).groupBy("kind", "node").agg(half(0).alias("a"), half(1).alias("b")).where("a is not null and b is not null")
    top = lambda c: policies.targets(h, ["kind"], "node", {c: [F.desc(c)]}, 10).select("kind", "node", F.lit(True).alias(f"t{c}"))
    x = h.join(top("a"), ["kind", "node"], "left").join(top("b"), ["kind", "node"], "left")
    x = x.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("ta") & F.col("tb")).alias("overlap"), (F.avg(F.when(F.col("tb"), F.col("b"))) - F.avg(F.when(F.col("ta"), F.col("b")))).alias("regret"))
    chance = F.pow(F.least(F.lit(10), "n"), F.lit(2)) / F.col("n")
    return x.select("kind", "n", "overlap", _r(chance, "chance", 9), _r("regret", "regret"), (F.col("overlap") > chance).alias("reproducible"))


@query(PRIOR + """, cells AS (SELECT kind, node, week, v FROM weekly), sz AS (SELECT kind, count(DISTINCT week) AS nc, count(DISTINCT node) AS ns FROM cells GROUP BY kind),
full_rows AS (SELECT kind, node FROM cells JOIN sz USING (kind) GROUP BY kind, node, nc HAVING count(*) = nc), w AS (SELECT cells.* FROM cells JOIN full_rows USING (kind, node)),
x AS (SELECT kind, node, v, avg(v) OVER (PARTITION BY kind, node) AS r, avg(v) OVER (PARTITION BY kind, week) AS c, avg(v) OVER (PARTITION BY kind) AS m FROM w),
s AS (SELECT kind, count(DISTINCT node) AS n_rows, sum((v - m) ** 2) AS t, sum((r - m) ** 2) AS sr, sum((c - m) ** 2) AS sc, sum((v - r - c + m) ** 2) AS se FROM x GROUP BY kind)
SELECT sz.kind, ns AS n_seen, coalesce(n_rows, 0) AS n_rows, nc AS n_cols, CASE WHEN coalesce(n_rows, 0) < 2 OR nc < 2 THEN 'not_estimable' WHEN t > 0 THEN 'estimated' ELSE 'constant_target' END AS status,
       round(sr / t, 9) AS row_fraction, round(sc / t, 9) AS col_fraction, round(se / t, 9) AS residual_fraction FROM sz LEFT JOIN s USING (kind)""")
def agg_variance_units(spark, sf_dir):
    """AGG-18, AGG-22: shares of variance by animal and by anchor in each network, with a status."""
    x = statistics.two_way(_weekly(spark, sf_dir), "node", "week", "v", ["kind"])
    return x.select("kind", "n_seen", "n_rows", "n_cols", "status", *(_r(n, n, 9) for n in ("row_fraction", "col_fraction", "residual_fraction")))


@query(WORLDS + """, g AS (SELECT kind, family, block, (reference - history) AS d FROM wide WHERE reference - history IS NOT NULL), o AS (SELECT kind, avg(d) AS observed FROM g WHERE block = 0 GROUP BY kind),
n AS (SELECT kind, block, avg(d) AS d FROM g WHERE block > 0 GROUP BY ALL)
SELECT kind, count(*) AS draws, round(any_value(observed), 9) AS observed, round((1 + count(*) FILTER (d >= observed)) / (count(*) + 1), 9) AS p FROM n JOIN o USING (kind) GROUP BY kind""")
def agg_randomization(spark, sf_dir):
    """AGG-61, JN-16, JN-26: the share of draws that reach what was observed, itself included."""
    g = contrasts.wide(_worlds(spark, sf_dir), KEYS, "policy", "burden", ["reference", "history"]).withColumn("d", F.col("reference") - F.col("history")).where("d is not null")
    o = g.where("block = 0").groupBy("kind").agg(F.avg("d").alias("observed"))
    n = g.where("block > 0").groupBy("kind", "block").agg(F.avg("d").alias("d")).join(o, "kind")
    return n.groupBy("kind").agg(F.count("*").alias("draws"), _r(F.first("observed"), "observed", 9), _r((1 + F.count_if(F.col("d") >= F.col("observed"))) / (F.count("*") + 1), "p", 9))


@query(WORLDS + """, a AS (SELECT family, kind, avg(burden) AS v FROM worlds WHERE policy = 'history' AND block < 8 GROUP BY ALL), b AS (SELECT family, kind, avg(burden) AS v FROM worlds WHERE policy = 'history' AND block > 1 GROUP BY ALL)
SELECT count(*) FILTER (a.kind IS NOT NULL AND b.kind IS NOT NULL) AS matched, count(*) FILTER (b.kind IS NULL) AS left_only, count(*) FILTER (a.kind IS NULL) AS right_only, 0::BIGINT AS repeated, round(coalesce(max(abs(a.v - b.v)), 0), 6) AS largest,
count(*) FILTER (a.kind IS NULL OR b.kind IS NULL) = 0 AND coalesce(max(abs(a.v - b.v)), 0) <= 1e-9 AS agree FROM a FULL JOIN b ON a.family = b.family AND a.kind = b.kind""")
def jn_reconstruction(spark, sf_dir):
    """JN-20, JN-29, JN-30: two tables that should agree, by a full outer join."""
    h = _worlds(spark, sf_dir).where("policy = 'history'")
    of = lambda c: h.where(c).groupBy("family", "kind").agg(F.avg("burden").alias("v"))
    return contrasts.reconstruction(of("block < 8"), of("block > 1"), ["family", "kind"], "v", 1e-9).withColumn("largest", F.round("largest", 6))


@query(WORLDS + """, d AS (SELECT kind, family, avg(reference - history) AS m, stddev_samp(reference - history) / sqrt(count(*)) AS se FROM wide WHERE reference - history IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN m - 1.96 * se > 0 THEN 'supported_positive' WHEN m + 1.96 * se < 0 THEN 'supported_negative' WHEN m > 0 THEN 'uncertain_positive' WHEN m < 0 THEN 'uncertain_negative' ELSE 'zero' END AS status FROM d),
f AS (SELECT kind, count(*) AS families, count(*) FILTER (m > 0) AS positive, count(*) FILTER (status = 'supported_positive') AS supported FROM s GROUP BY kind)
SELECT kind, families, positive, supported, CASE WHEN positive >= 0.8 * families AND supported > 0 THEN 'adopt' WHEN positive <= 0.2 * families THEN 'avoid' ELSE 'undecided' END AS decision FROM f""")
def jn_decision_map(spark, sf_dir):
    """JN-21 to JN-23, AGG-35, AGG-36, AGG-41: effects by the sign of their interval, and a decision of each cell."""
    w = contrasts.wide(_worlds(spark, sf_dir), KEYS, "policy", "burden", ["reference", "history"]).withColumn("d", F.col("reference") - F.col("history")).where("d is not null")
    d = w.groupBy("kind", "family").agg(F.avg("d").alias("m"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))
    d = d.withColumn("status", contrasts.effect_status(F.col("m"), F.col("m") - 1.96 * F.col("se"), F.col("m") + 1.96 * F.col("se")))
    f = d.groupBy("kind").agg(F.count("*").alias("families"), F.count_if(F.col("m") > 0).alias("positive"), F.count_if(F.col("status") == "supported_positive").alias("supported"))
    return f.withColumn("decision", F.when((F.col("positive") >= 0.8 * F.col("families")) & (F.col("supported") > 0), "adopt").when(F.col("positive") <= 0.2 * F.col("families"), "avoid").otherwise("undecided"))


PHASES = [("early", WEEK_2, WEEK_2 + 4 * DAY, 0.25), ("late", WEEK_2 + 4 * DAY, WEEK_3, 0.5)]
CUTS = [WEEK_2, WEEK_2 + 4 * DAY, WEEK_3]


@query(f"""+ c AS (SELECT event_id, source_id, target_id, start, "end", list_sort(list_filter([{', '.join(map(str, CUTS))}], lambda p: p > start AND p < "end")) AS inside FROM dyads WHERE "end" > start),
e AS (SELECT *, list_concat(list_concat([start], inside), ["end"]) AS edges FROM c), s AS (SELECT event_id, source_id, target_id, edges, unnest(range(1, len(edges))) AS i FROM e),
g AS (SELECT event_id, source_id, target_id, (i - 1)::INT AS part, edges[i] AS start, edges[i + 1] AS "end" FROM s),
a AS (SELECT *, CASE WHEN (start + "end") / 2.0::DOUBLE >= {WEEK_2} AND (start + "end") / 2.0::DOUBLE < {WEEK_2 + 4 * DAY} THEN 0.25 WHEN (start + "end") / 2.0::DOUBLE >= {WEEK_2 + 4 * DAY} AND (start + "end") / 2.0::DOUBLE < {WEEK_3} THEN 0.5 END AS residual FROM g)
SELECT event_id, part, start, "end", round(2.0 * CASE WHEN residual IS NULL THEN 1 ELSE pow(residual::DOUBLE, (source_id % 7 = 0)::INT + (target_id % 7 = 0)::INT) END, 9) AS multiplier FROM a""")
def int_contact_schedule(spark, sf_dir):
    """INT-05, INT-07, INT-08: intervals cut where phases change, and reduced for each targeted end."""
    d = canonical.dyads(spark, sf_dir).select("event_id", "source_id", "target_id", "start", "end", F.lit(2.0).alias("multiplier"))
    phases = spark.createDataFrame(PHASES, "phase string, start long, end long, residual double")
    nodes = d.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct().where("node % 7 = 0")
    targets = nodes.withColumn("phase", F.explode(F.array(F.lit("early"), F.lit("late")))).select("phase", "node")
    x = intervals.reduced(intervals.cut_at(d, CUTS), phases, targets)
    return x.select("event_id", "part", "start", "end", _r("multiplier", "multiplier", 9))


@query("""SELECT 'user:' || trim(source_id::VARCHAR) AS node_id, min(start) AS first_seen, max("end") AS last_seen, count(*) AS n FROM (SELECT source_id, start, "end" FROM dyads UNION ALL SELECT target_id, start, "end" FROM dyads) GROUP BY ALL""")
def pf_individuals(spark, sf_dir):
    """PF-01 to PF-03, JN-01, JN-02: individuals from endpoints, with the bounds of their observation."""
    d = canonical.dyads(spark, sf_dir)
    ends = d.select(F.explode(F.array("source_id", "target_id")).alias("node"), "start", "end")
    ends = ends.withColumn("node_id", F.concat(F.lit("user:"), contract.node_id(F.col("node"))))
    return contract.observed(ends, "node_id")


@query(f"""+ e AS (SELECT event_id, source_id, target_id, start, "end", kind FROM dyads WHERE source_id <> target_id AND "end" > start)
SELECT event_id, source_id, target_id, start, "end", 1.0::DOUBLE AS multiplier, 'duration' AS mapper FROM e WHERE kind = 'click'
UNION ALL SELECT event_id, source_id, target_id, start, "end", 0.5::DOUBLE, 'detection' FROM e WHERE kind = 'purchase' AND "end" - start >= {HOUR}""")
def pf_mapper_streams(spark, sf_dir):
    """PF-09 to PF-11, PF-14, PF-15, SET-01: exposures of two mappers, combined."""
    d = canonical.dyads(spark, sf_dir)
    one = contract.exposures(d.where("kind = 'click'"), "duration", F.lit(1.0))
    two = contract.exposures(d.where(F.col("kind") == "purchase").where(F.col("end") - F.col("start") >= HOUR), "detection", F.lit(0.5))
    return contract.combined(one, two)


@query(f"""+ e AS (SELECT * FROM dyads WHERE kind = 'click'), i AS (SELECT source_id AS node FROM dyads WHERE kind = 'purchase'),
n AS (SELECT source_id AS node FROM e UNION SELECT target_id FROM e)
SELECT 'bad_interval' AS code, count(*) FILTER ("end" <= start OR start IS NULL OR "end" IS NULL) AS n FROM e
UNION ALL SELECT 'bad_multiplier', count(*) FILTER (weight < 0 OR weight IS NULL) FROM e UNION ALL SELECT 'orphan_nodes', count(*) FROM (SELECT node FROM n EXCEPT SELECT node FROM i)
UNION ALL SELECT 'duplicate_members', count(*) FROM (SELECT group_id, node_id FROM memberships GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'small_groups', count(*) FROM (SELECT group_id FROM memberships GROUP BY ALL HAVING count(*) < 2)""")
def pf_validate_stream(spark, sf_dir):
    """PF-07, PF-08, SET-05 to SET-07: checks of a stream and of the nodes that it names."""
    d, m = canonical.dyads(spark, sf_dir), canonical.memberships(spark, sf_dir)
    return contract.stream_issues(d.where("kind = 'click'"), m, d.where("kind = 'purchase'").select(F.col("source_id").alias("node")))
