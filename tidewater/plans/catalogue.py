"""Registry of the engine's queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import keyed, ranks
from tidewater.operators import exposure, intervals, statistics
from tidewater.sources import canonical
from tidewater.sources.canonical import DAY, HOUR

WEEK = 7 * DAY
#: 2024-01-01, -08 and -15 in microseconds.
ORIGIN, WEEK_2, WEEK_3 = 1_704_067_200_000_000, 1_704_672_000_000_000, 1_705_276_800_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, tables: bool = True) -> Callable:
    """Register a query, and its SQL where it has one; `tables` puts the canonical tables before it."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {canonical.SQL.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().lstrip('+')}" if tables else sql
        return f

    return add


def _r(c, name: str, digits: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), digits).alias(name)


PAIRS = """+ sized AS (SELECT group_id, node_id, kind, count(*) OVER (PARTITION BY group_id) AS n FROM memberships),
pairs AS (
  SELECT a.node_id AS a, b.node_id AS b, count(*) AS n_events, sum(3600.0::DOUBLE / (a.n - 1)) AS contact_seconds
  FROM sized a JOIN sized b ON a.group_id = b.group_id AND a.node_id < b.node_id GROUP BY ALL)"""


def _pairs(spark, sf_dir):
    return exposure.group_pairs(canonical.memberships(spark, sf_dir), 3600.0)


@query(PAIRS + " SELECT a, b, n_events, round(contact_seconds, 6) AS contact_seconds FROM pairs")
def coattendance_pairs(spark, sf_dir):
    """AGG-02, PF-13: pair exposure from hourly groups."""
    return _pairs(spark, sf_dir).select("a", "b", "n_events", _r("contact_seconds", "contact_seconds"))


@query("""SELECT 'dyads' AS name, count(*) AS n, min(start) AS first, max("end") AS last FROM dyads
UNION ALL SELECT 'groups', count(*), min(start), max(start) + 3600000000 FROM (SELECT DISTINCT group_id, start FROM memberships)
UNION ALL SELECT 'memberships', count(*), min(start), max(start) + 3600000000 FROM memberships
UNION ALL SELECT 'individuals', count(*), NULL, NULL FROM (SELECT source_id FROM dyads UNION SELECT target_id FROM dyads)""")
def src_bundle_summary(spark, sf_dir):
    """SRC-03: rows and time range of each canonical table."""
    d, m = canonical.dyads(spark, sf_dir), canonical.memberships(spark, sf_dir)
    g = m.select("group_id", "start").distinct()
    who = d.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    of = lambda t, name, a, b: t.agg(F.count("*").alias("n"), a.cast("long").alias("first"), b.cast("long").alias("last")).select(F.lit(name).alias("name"), "n", "first", "last")
    end = F.max("start") + HOUR
    return of(d, "dyads", F.min("start"), F.max("end")).union(of(g, "groups", F.min("start"), end)).union(of(m, "memberships", F.min("start"), end)).union(of(who, "individuals", F.lit(None), F.lit(None)))


@query("""+ c AS (
  SELECT count(*) AS a, count(*) FILTER (source_id = target_id) AS self_loop, count(*) FILTER (source_id IS NULL OR target_id IS NULL) AS missing_endpoint,
         count(*) FILTER ("end" < start) AS reversed_time, count(*) FILTER ("end" = start) AS zero_duration, count(*) FILTER (start IS NULL OR "end" IS NULL) AS missing_time,
         count(*) FILTER (isnan(weight)) AS not_finite, (count(*) - count(DISTINCT event_id)) AS duplicate_id FROM dyads),
x AS (SELECT a, unnest(['high', 'critical', 'high', 'medium', 'critical', 'medium', 'critical']) AS severity,
  unnest(['self_loop', 'missing_endpoint', 'reversed_time', 'zero_duration', 'missing_time', 'not_finite', 'duplicate_id']) AS code,
  unnest([self_loop, missing_endpoint, reversed_time, zero_duration, missing_time, not_finite, duplicate_id]) AS n FROM c)
SELECT severity, code, n, round(n / a, 9) AS fraction FROM x""")
def pf_validate_issues(spark, sf_dir):
    """PF-04, PF-05: data-quality checks."""
    return exposure.issues(canonical.dyads(spark, sf_dir)).withColumn("fraction", F.round("fraction", 9))


@query(f"""SELECT event_id, greatest(start, {WEEK_2}) AS start, least("end", {WEEK_3}) AS "end" FROM dyads WHERE start < {WEEK_3} AND "end" > {WEEK_2}""")
def pf_slice_stream(spark, sf_dir):
    """PF-16: overlap filter and clip."""
    return intervals.clipped(canonical.dyads(spark, sf_dir), WEEK_2, WEEK_3).select("event_id", "start", "end")


@query("""SELECT event_id, round(2.0 * (weight / 500) / (("end" - start) / 1e6), 9) AS linear, round(2.0 * (1 - exp(-(weight / 500))) / (("end" - start) / 1e6), 9) AS saturating
FROM dyads WHERE "end" > start AND source_id <> target_id""")
def pf_mapper_association(spark, sf_dir):
    """PF-12: hazard from an association index, linear and saturating."""
    return exposure.association_rates(canonical.dyads(spark, sf_dir), 2.0, 500.0).select("event_id", _r("linear", "linear", 9), _r("saturating", "saturating", 9))


@query("""SELECT source_id, target_id, kind, count(*) AS n, round(sum(("end" - start) / 1e6), 3) AS seconds FROM dyads
WHERE source_id % 5 = 1 AND target_id % 5 = 1 AND source_id <> target_id GROUP BY ALL""")
def pf_restrict_population(spark, sf_dir):
    """PF-17, PF-19: the induced sub-stream of a population."""
    d = canonical.dyads(spark, sf_dir).where("source_id % 5 = 1 and target_id % 5 = 1 and source_id <> target_id")
    return d.groupBy("source_id", "target_id", "kind").agg(F.count("*").alias("n"), _r(F.sum((F.col("end") - F.col("start")) / 1e6), "seconds", 3))


ISLANDS = """+ marked AS (
  SELECT {by}, start, "end", CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w + {gap} THEN 1 ELSE 0 END AS fresh FROM {source}
  WINDOW w AS (PARTITION BY {by} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
islands AS (SELECT {by}, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM numbered GROUP BY {by}, island)"""


@query(ISLANDS.format(by="kind, source_id", gap=0, source="dyads") + """ SELECT kind, source_id, start, "end", n_merged FROM islands""")
def int_coalesce(spark, sf_dir):
    """INT-01, INT-02: unions of overlapping or touching intervals."""
    return intervals.islands(canonical.dyads(spark, sf_dir), ["kind", "source_id"])


@query(ISLANDS.format(by="source_id", gap=2 * HOUR, source="dyads") + """ SELECT source_id, start, "end", n_merged FROM islands""")
def int_sessions_gap(spark, sf_dir):
    """INT-04: recording segments, apart by more than two hours."""
    return intervals.islands(canonical.dyads(spark, sf_dir), ["source_id"], 2 * HOUR)


@query("""+ clips AS (SELECT source_id, greatest(start, %d) AS start, least("end", %d) AS "end" FROM dyads WHERE start < %d AND "end" > %d),
""" % (WEEK_2, WEEK_3, WEEK_3, WEEK_2) + ISLANDS.format(by="source_id", gap=0, source="clips").lstrip("+ ") + f""", roster AS (SELECT DISTINCT source_id FROM dyads), sums AS (SELECT source_id, sum("end" - start) / {WEEK} AS covered FROM islands GROUP BY source_id)
SELECT source_id, round(coalesce(covered, 0), 9) AS covered FROM roster LEFT JOIN sums USING (source_id)""")
def int_merge_fraction(spark, sf_dir):
    """INT-03: the share of a window that a node's intervals cover."""
    return intervals.coverage(canonical.dyads(spark, sf_dir), ["source_id"], WEEK_2, WEEK_3).select("source_id", _r("covered", "covered", 9))


@query(f"""+ k AS (
  SELECT *, unnest(range((start - {ORIGIN}) // {6 * HOUR}, ("end" - 1 - {ORIGIN}) // {6 * HOUR} + 1)) AS k FROM dyads WHERE "end" > start)
SELECT event_id, (k - (start - {ORIGIN}) // {6 * HOUR})::INT AS part, greatest(start, {ORIGIN} + k * {6 * HOUR}) AS start, least("end", {ORIGIN} + (k + 1) * {6 * HOUR}) AS "end" FROM k""")
def int_segment(spark, sf_dir):
    """INT-05, INT-06: intervals cut at every sixth hour."""
    return intervals.segments(canonical.dyads(spark, sf_dir), 6 * HOUR, ORIGIN).select("event_id", "part", "start", "end")


@query(f"""+ spans AS (SELECT kind, min(start) // {DAY} * {DAY} AS low, max(start) AS high FROM dyads GROUP BY kind)
SELECT kind, unnest(range(low + {WEEK}, high - {WEEK} + 1, {DAY})) AS anchor, unnest(range(low, high - {2 * WEEK} + 1, {DAY})) AS history_start,
       unnest(range(low + {2 * WEEK}, high + 1, {DAY})) AS horizon_end FROM spans WHERE high - low >= {2 * WEEK}""")
def int_rolling_anchors(spark, sf_dir):
    """INT-13, INT-19: sliding evaluation windows of each network."""
    spans = canonical.dyads(spark, sf_dir).groupBy("kind").agg((F.floor(F.min("start") / DAY) * DAY).alias("low"), F.max("start").alias("high"))
    return intervals.rolling_anchors(spans, WEEK, WEEK, DAY).select("kind", "anchor", "history_start", "horizon_end")


@query("""SELECT date_trunc('week', ts)::DATE AS week, event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""", tables=False)
def int_week_windows(spark, sf_dir):
    """INT-20: calendar weeks from Monday."""
    e = canonical.events(spark, sf_dir)
    return e.groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"""+ k AS (SELECT *, unnest(range((start - {ORIGIN}) // {DAY}, ("end" - 1 - {ORIGIN}) // {DAY} + 1)) AS k FROM dyads WHERE "end" > start AND source_id <> target_id)
SELECT k AS snapshot, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS n_events,
       round(sum((least("end", {ORIGIN} + (k + 1) * {DAY}) - greatest(start, {ORIGIN} + k * {DAY})) / 1e6), 3) AS seconds FROM k GROUP BY ALL""")
def int_snapshots(spark, sf_dir):
    """INT-24, AGG-02: daily snapshots of the contact graph."""
    cut = intervals.windows(canonical.dyads(spark, sf_dir).where("source_id <> target_id"), ORIGIN, DAY, DAY, "snapshot")
    return cut.groupBy("snapshot", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(
        F.count("*").alias("n_events"), _r(F.sum((F.col("end") - F.col("start")) / 1e6), "seconds", 3))


@query(f"""SELECT source_id, round(sum((least("end", {WEEK_3}) - start) / 1e6 * pow(0.5, ({WEEK_3} - (start + least("end", {WEEK_3})) / 2.0::DOUBLE) / {3 * DAY}.0::DOUBLE)), 3) AS decayed
FROM dyads WHERE start < {WEEK_3} AND "end" > {ORIGIN} AND start >= {ORIGIN} GROUP BY source_id""")
def st_decayed_scores(spark, sf_dir):
    """INT-10, ST-12: contact that halves every three days before the anchor."""
    d = intervals.clipped(canonical.dyads(spark, sf_dir), ORIGIN, WEEK_3)
    return d.groupBy("source_id").agg(_r(F.sum(intervals.decayed(F.col("start"), F.col("end"), WEEK_3, 3.0 * DAY) / 1e6), "decayed", 3))


@query(PAIRS + """, ends AS (SELECT a AS node, contact_seconds AS w FROM pairs UNION ALL SELECT b, w FROM (SELECT b, contact_seconds AS w FROM pairs))
SELECT node, count(*) AS degree, round(sum(w), 6) AS strength FROM ends GROUP BY node""")
def gr_degree_strength(spark, sf_dir):
    """GR-01, AGG-03: degree and strength in the contact graph."""
    return exposure.group_strength(canonical.memberships(spark, sf_dir), 3600.0).select("node", "degree", _r("strength", "strength"))


@query("""+ ends AS (SELECT source_id AS node, start, "end" FROM dyads UNION ALL SELECT target_id, start, "end" FROM dyads)
SELECT node, count(*) AS n, min(start) AS first, max("end") AS last FROM ends GROUP BY node""")
def agg_node_support(spark, sf_dir):
    """AGG-01, AGG-05, AGG-68: events and observed time range of each node."""
    d = canonical.dyads(spark, sf_dir).select(F.explode(F.array("source_id", "target_id")).alias("node"), "start", "end")
    return d.groupBy("node").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


FEATURES = f"""+ ends AS (
  SELECT source_id AS node, target_id AS partner, start, "end", kind FROM dyads WHERE source_id <> target_id
  UNION ALL SELECT target_id, source_id, start, "end", kind FROM dyads WHERE source_id <> target_id),
k AS (SELECT *, unnest(range((start - {ORIGIN}) // {WEEK}, ("end" - 1 - {ORIGIN}) // {WEEK} + 1)) AS "window" FROM ends WHERE "end" > start),
clips AS (SELECT node, partner, kind, "window", {ORIGIN} + "window" * {WEEK} AS ws, greatest(start, {ORIGIN} + "window" * {WEEK}) AS s, least("end", {ORIGIN} + ("window" + 1) * {WEEK}) AS e FROM k),
features AS (
  SELECT "window", node, count(*) AS activity_count, sum((e - s) / 1e6) AS contact_seconds, count(DISTINCT partner) AS observed_partners, count(DISTINCT kind) AS kinds,
         1 - (max(ws) + {WEEK} - max(e)) / {WEEK} AS recency, avg((s - ws >= {WEEK // 2})::INT) AS recent_share, CASE WHEN count(*) > 1 THEN (max(e) - min(s)) / {WEEK} ELSE 0 END AS active_span FROM clips GROUP BY "window", node)"""


def _features(spark, sf_dir):
    ends = exposure.endpoints(canonical.dyads(spark, sf_dir).select("source_id", "target_id", "start", "end", "kind"))
    clips = intervals.windows(ends, ORIGIN, WEEK, WEEK)
    return exposure.history_features(clips.withColumn("window_start", ORIGIN + F.col("window") * WEEK), WEEK)


@query(FEATURES + """ SELECT "window", node, activity_count, round(contact_seconds, 3) AS contact_seconds, observed_partners, kinds,
round(recency, 9) AS recency, round(recent_share, 9) AS recent_share, round(active_span, 9) AS active_span FROM features""")
def agg_history_features(spark, sf_dir):
    """AGG-06, AGG-07, AGG-09: features of each candidate from the week before each anchor."""
    f = _features(spark, sf_dir)
    return f.select("window", "node", "activity_count", _r("contact_seconds", "contact_seconds", 3), "observed_partners", "kinds", _r("recency", "recency", 9), _r("recent_share", "recent_share", 9), _r("active_span", "active_span", 9))


RANKS = FEATURES + """, ranked AS (
  SELECT *, rank() OVER (PARTITION BY "window" ORDER BY activity_count) + (count(*) OVER (PARTITION BY "window", activity_count) - 1) / 2.0::DOUBLE AS r,
         rank() OVER (PARTITION BY "window" ORDER BY observed_partners) + (count(*) OVER (PARTITION BY "window", observed_partners) - 1) / 2.0::DOUBLE AS q,
         count(*) OVER (PARTITION BY "window") AS n FROM features)"""


@query(RANKS + """ SELECT "window", node, round(r / n, 9) AS activity_rank, round(q / n, 9) AS partner_rank FROM ranked""")
def rk_pct_features(spark, sf_dir):
    """RK-02: percentile ranks with ties in each context."""
    f = _features(spark, sf_dir)
    f = ranks.average_rank(ranks.average_rank(f, "activity_count", ["window"], "activity_rank", True), "observed_partners", ["window"], "partner_rank", True)
    return f.select("window", "node", _r("activity_rank", "activity_rank", 9), _r("partner_rank", "partner_rank", 9))


@query(RANKS + """ SELECT "window", count(*) AS n, CASE WHEN min(r) < max(r) AND min(q) < max(q) THEN round(corr(r, q), 9) END AS spearman FROM ranked GROUP BY "window" """)
def rk_spearman(spark, sf_dir):
    """SC-23: rank correlation of two features in each context."""
    return ranks.spearman(_features(spark, sf_dir), "activity_count", "observed_partners", ["window"]).withColumn("spearman", F.round("spearman", 9))


@query(FEATURES + """, chosen AS (SELECT "window", node, activity_count, row_number() OVER (PARTITION BY "window" ORDER BY activity_count DESC, node) AS position FROM features)
SELECT "window", node, activity_count, position::INT AS position FROM chosen WHERE position <= 10""")
def rk_policy_topk(spark, sf_dir):
    """RK-09: the ten most active candidates of each context."""
    f = _features(spark, sf_dir).select("window", "node", "activity_count")
    return ranks.first_k(f, ["window"], [F.desc("activity_count"), F.col("node")], 10)


@query(FEATURES + """, top AS (SELECT "window", node FROM (SELECT "window", node, row_number() OVER (PARTITION BY "window" ORDER BY activity_count DESC, node) AS p FROM features) WHERE p <= 20),
both_weeks AS (SELECT b."window" AS w, count(a.node) AS kept, count(*) AS n FROM top b LEFT JOIN top a ON a."window" = b."window" - 1 AND a.node = b.node WHERE b."window" > 0 GROUP BY b."window")
SELECT w AS "window", kept AS overlap, round(kept / (40 - kept), 9) AS jaccard FROM both_weeks WHERE n = 20""")
def set_retention(spark, sf_dir):
    """SET-02, RK-06: how much of a selected set stays from one context to the next."""
    top = ranks.first_k(_features(spark, sf_dir).select("window", "node", "activity_count"), ["window"], [F.desc("activity_count"), F.col("node")], 20)
    before = top.select((F.col("window") + 1).alias("window"), "node", F.lit(1).alias("was"))
    both = top.where("window > 0").join(before, ["window", "node"], "left").groupBy("window").agg(F.count("was").alias("overlap"), F.count("*").alias("n")).where("n = 20")
    return both.select("window", "overlap", F.round(F.col("overlap") / (40 - F.col("overlap")), 9).alias("jaccard"))


@query("""+ u AS (SELECT DISTINCT source_id AS node FROM dyads),
k AS (SELECT node, '0x' || substr(sha256('17' || chr(31) || 'order' || chr(31) || node), 1, 16) AS h, '0x' || substr(sha256('17' || chr(31) || 'seed' || chr(31) || node), 1, 16) AS g FROM u)
SELECT node, round((h::UBIGINT::DOUBLE + 0.5) / 18446744073709551616.0::DOUBLE, 12) AS uniform, round(-ln((h::UBIGINT::DOUBLE + 0.5) / 18446744073709551616.0::DOUBLE), 9) AS exponential,
       (g::UBIGINT % 9223372036854775807::UBIGINT)::BIGINT AS seed, (h::UBIGINT::DOUBLE + 0.5) / 18446744073709551616.0::DOUBLE < 0.3 AS thinned,
       row_number() OVER (ORDER BY h, node) AS position FROM k""")
def sc_keyed_uniform(spark, sf_dir):
    """SC-01 to SC-03, SC-11, RK-04: keyed numbers, seeds, thinning and the order by hash."""
    u = canonical.dyads(spark, sf_dir).select(F.col("source_id").alias("node")).distinct()
    x = u.select("node", keyed.uniform(17, "order", F.col("node")).alias("u"), keyed.exponential(17, "order", F.col("node")).alias("e"), keyed.seed(17, "seed", F.col("node")).alias("seed"))
    one = ranks.hash_position(x, "u", "node")
    return one.select("node", _r("u", "uniform", 12), _r("e", "exponential", 9), "seed", (F.col("u") < 0.3).alias("thinned"), "position")


@query("""+ u AS (SELECT DISTINCT source_id AS node FROM dyads), s AS (SELECT node, unnest(range(4)) AS s FROM u)
SELECT node, round(sum(-ln((('0x' || substr(sha256('clock' || chr(31) || node || chr(31) || s), 1, 16))::UBIGINT::DOUBLE + 0.5) / 18446744073709551616.0::DOUBLE)) / (4 * 0.5), 9) AS duration
FROM s GROUP BY node""")
def sc_erlang(spark, sf_dir):
    """SC-13: keyed Erlang durations."""
    u = canonical.dyads(spark, sf_dir).select(F.col("source_id").alias("node")).distinct()
    return u.select("node", _r(keyed.erlang(4, 0.5, "clock", F.col("node")), "duration", 9))


@query("""+ a AS (SELECT source_id % 5 AS family, kind, source_id AS unit, avg(weight) AS m FROM dyads GROUP BY ALL), b AS (SELECT family, kind, avg(m) AS m FROM a GROUP BY ALL),
f AS (SELECT family, avg(m) AS m FROM b GROUP BY family)
SELECT family, round(m, 9) AS mean, round((sum(m) OVER () - m) / (count(*) OVER () - 1), 9) AS others FROM f""")
def agg_hierarchical_mean(spark, sf_dir):
    """AGG-20, AGG-31, AGG-52: means of means, and each family against all others."""
    d = canonical.dyads(spark, sf_dir).withColumn("family", F.col("source_id") % 5)
    f = statistics.leave_one_out(statistics.hierarchical_mean(d, ["family", "kind", "source_id"], "weight"), "mean")
    return f.select("family", _r("mean", "mean", 9), _r("others", "others", 9))


@query("""+ c AS (SELECT kind, source_id % 5 AS family, avg(weight) - (SELECT avg(weight) FROM dyads) AS d FROM dyads GROUP BY ALL),
n AS (SELECT kind, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d <> 0) AS n FROM c GROUP BY kind)
SELECT kind, positive, n, round((SELECT sum(factorial(n::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((n - i)::INT)::DOUBLE)) FROM (SELECT unnest(range(positive, n + 1)) AS i)) / pow(2, n), 9) AS p FROM n""")
def agg_sign_test(spark, sf_dir):
    """AGG-32: one-sided sign test over families."""
    d = canonical.dyads(spark, sf_dir)
    mean = F.broadcast(d.agg(F.avg("weight").alias("m")))  # one row
    c = d.groupBy("kind", (F.col("source_id") % 5).alias("family")).agg(F.avg("weight").alias("v")).crossJoin(mean).withColumn("d", F.col("v") - F.col("m"))
    n = c.groupBy("kind").agg(F.count_if(F.col("d") > 0).alias("positive"), F.count_if(F.col("d") != 0).alias("n"))
    return n.select("kind", "positive", "n", _r(statistics.binomial_tail(F.col("positive"), F.col("n")), "p", 9))


@query("""+ cells AS (SELECT source_id AS r, kind AS c, avg(weight) AS v FROM dyads GROUP BY ALL),
whole AS (SELECT * FROM cells WHERE r IN (SELECT r FROM cells GROUP BY r HAVING count(*) = (SELECT count(DISTINCT c) FROM cells))),
x AS (SELECT v, avg(v) OVER (PARTITION BY r) AS rm, avg(v) OVER (PARTITION BY c) AS cm, avg(v) OVER () AS m FROM whole)
SELECT count(*) AS n_cells, round(sum((v - m) ** 2), 3) AS ss_total, round(sum((rm - m) ** 2), 3) AS ss_rows, round(sum((cm - m) ** 2), 3) AS ss_cols, round(sum((v - rm - cm + m) ** 2), 3) AS ss_residual FROM x""")
def agg_anova(spark, sf_dir):
    """AGG-18, AGG-19: two-way decomposition on complete rows."""
    x = statistics.two_way(canonical.dyads(spark, sf_dir), "source_id", "kind", "weight")
    return x.select("n_cells", *(_r(c, c, 3) for c in ("ss_total", "ss_rows", "ss_cols", "ss_residual")))


@query(FEATURES + """, p AS (SELECT b."window", a.activity_count::DOUBLE AS predicted, b.activity_count::DOUBLE AS observed FROM features b JOIN features a ON a.node = b.node AND a."window" = b."window" - 1)
SELECT "window", count(*) AS n, round(avg(abs(predicted - observed)), 9) AS mae, round(sqrt(avg((predicted - observed) ** 2)), 9) AS rmse, round(regr_slope(observed, predicted), 9) AS slope,
       round(regr_intercept(observed, predicted), 9) AS intercept, round(quantile_cont(observed, 0.9) - quantile_cont(observed, 0.1), 9) AS spread FROM p GROUP BY "window" """)
def agg_calibration_summary(spark, sf_dir):
    """AGG-64, AGG-66, AGG-67: last week's activity as a forecast of this week's."""
    f = _features(spark, sf_dir).select("window", "node", F.col("activity_count").cast("double").alias("observed"))
    before = f.select((F.col("window") + 1).alias("window"), "node", F.col("observed").alias("predicted"))
    x = statistics.calibration(f.join(before, ["window", "node"]), ["window"], "predicted", "observed")
    return x.select("window", "n", *(_r(c, c, 9) for c in ("mae", "rmse", "slope", "intercept", "spread")))


@query("""+ m AS (SELECT source_id, max(CASE WHEN kind = 'purchase' THEN w END) AS p, max(CASE WHEN kind = 'click' THEN w END) AS c FROM (SELECT source_id, kind, sum(weight) AS w FROM dyads GROUP BY ALL) GROUP BY source_id)
SELECT source_id, round(p - c, 6) AS increment, p > c AS better FROM m WHERE p IS NOT NULL AND c IS NOT NULL""")
def jn_increments(spark, sf_dir):
    """JN-05 to JN-10: challenger against baseline on one key, by conditional aggregation and not by a self-join."""
    w = canonical.dyads(spark, sf_dir).where(F.col("kind").isin("purchase", "click")).groupBy("source_id").agg(
        F.sum(F.when(F.col("kind") == "purchase", F.col("weight"))).alias("p"), F.sum(F.when(F.col("kind") == "click", F.col("weight"))).alias("c"))
    d = F.col("p") - F.col("c")  # a zero that was rounded keeps its sign, as in SQL
    return w.where("p is not null and c is not null").select("source_id", (F.signum(d) * F.round(F.abs(d), 6)).alias("increment"), (F.col("p") > F.col("c")).alias("better"))


@query("""+ t AS (SELECT node, partner, start FROM (SELECT source_id AS node, target_id AS partner, start FROM dyads UNION ALL SELECT target_id, source_id, start FROM dyads) WHERE node <> partner),
f AS (SELECT node, partner, min(start) AS start FROM t GROUP BY ALL)
SELECT node, partner, start, (row_number() OVER (PARTITION BY node ORDER BY start, partner))::INT AS position FROM f""")
def st_first_contacts(spark, sf_dir):
    """ST-13: each node's partners in the order of first contact."""
    ends = exposure.endpoints(canonical.dyads(spark, sf_dir).select("source_id", "target_id", "start")).groupBy("node", "partner").agg(F.min("start").alias("start"))
    return ranks.first_k(ends, ["node"], [F.col("start"), F.col("partner")], 1 << 30)


@query("""SELECT l.l_suppkey % 10 AS supplier_group, o.o_custkey % 10 AS customer_group, date_trunc('month', l.l_shipdate)::DATE AS month, count(*) AS n, round(sum(l.l_quantity), 3) AS days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY ALL""", tables=False)
def big_dyads_monthly(spark, sf_dir):
    """AGG-02 at volume: supplier and customer contact by month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity").join(o, "l_orderkey")
    return x.groupBy((F.col("l_suppkey") % 10).alias("supplier_group"), (F.col("o_custkey") % 10).alias("customer_group"), F.date_trunc("month", "l_shipdate").cast("date").alias("month")).agg(
        F.count("*").alias("n"), _r(F.sum("l_quantity"), "days", 3))
