"""Queries over a dataset of the canonical contract, projected from the generated events, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import history, intervals
from tidewater.plans.catalogue import DAY, HOUR, ORIGIN, WEEK, WEEK_2, WEEK_3, _r, query
from tidewater.sources import canonical, dataset, streams

TABLES = f"""+ pairs AS (
  SELECT event_id::VARCHAR AS event_id, 'n' || source_id AS source_id, 'n' || target_id AS target_id, CASE WHEN event_id % 211 <> 0 THEN start END AS start, "end",
         weight * 60 + CASE WHEN event_id % 53 = 0 THEN 5 ELSE 0 END AS duration_seconds, CASE WHEN kind = 'view' THEN 'fixed_bin' ELSE 'interval' END AS event_representation,
         CASE WHEN kind = 'error' THEN 'direct_behavior' ELSE 'sensor_proximity' END AS edge_semantics, CASE WHEN kind = 'signup' THEN 'association_index' ELSE 'duration' END AS measurement_type,
         CASE WHEN event_id % 301 <> 0 THEN weight END AS measurement_value, 'l' || source_id % 4 AS location_id, directed, CASE WHEN event_id % 97 = 0 THEN 'exact_duplicate_source_record' END AS quality_flag FROM dyads),
grps AS (SELECT DISTINCT group_id AS group_event_id, start, start + CASE WHEN start // {HOUR} % 31 = 0 THEN 0 ELSE {HOUR} END AS "end", CASE WHEN start // {HOUR} % 31 = 0 THEN 0.0 ELSE 3600.0 END::DOUBLE AS duration_seconds FROM memberships WHERE start // {HOUR} % 29 <> 0),
mems AS (SELECT group_id AS group_event_id, 'n' || node_id AS node_id, 1.0::DOUBLE AS membership_weight FROM memberships),
who AS (SELECT DISTINCT source_id AS node_id FROM pairs WHERE substr(source_id, 2)::BIGINT % 50 <> 7)"""


def _dataset(spark, sf_dir) -> dataset.Dataset:
    d, m = canonical.dyads(spark, sf_dir), canonical.memberships(spark, sf_dir)
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    i = F.col("event_id")
    pairs = d.select(
        i.cast("string").alias("event_id"), name("source_id").alias("source_id"), name("target_id").alias("target_id"), F.when(i % 211 != 0, F.col("start")).alias("start"), "end",
        (F.col("weight") * 60 + F.when(i % 53 == 0, 5).otherwise(0)).alias("duration_seconds"), F.when(F.col("kind") == "view", "fixed_bin").otherwise("interval").alias("event_representation"),
        F.when(F.col("kind") == "error", "direct_behavior").otherwise("sensor_proximity").alias("edge_semantics"), F.when(F.col("kind") == "signup", "association_index").otherwise("duration").alias("measurement_type"),
        F.when(i % 301 != 0, F.col("weight")).alias("measurement_value"), F.concat(F.lit("l"), (F.col("source_id") % 4).cast("string")).alias("location_id"), "directed", F.when(i % 97 == 0, dataset.DUPLICATE).alias("quality_flag"))
    none = F.floor(F.col("start") / HOUR) % 31 == 0
    groups = m.where(F.floor(F.col("start") / HOUR) % 29 != 0).select("group_id", "start").distinct().select(
        F.col("group_id").alias("group_event_id"), "start", (F.col("start") + F.when(none, 0).otherwise(HOUR)).alias("end"), F.when(none, 0.0).otherwise(3600.0).alias("duration_seconds"))
    members = m.select(F.col("group_id").alias("group_event_id"), name("node_id").alias("node_id"), F.lit(1.0).alias("membership_weight"))
    who = d.where("source_id % 50 <> 7").select(name("source_id").alias("node_id")).distinct()
    return dataset.Dataset(spark, "events", {"individuals": who, "dyadic_events": pairs, "group_events": groups, "group_memberships": members})


@query(TABLES + """ SELECT 'individuals' AS name, count(*) AS n, NULL::BIGINT AS first, NULL::BIGINT AS last FROM who UNION ALL SELECT 'dyadic_events', count(*), min(start), max("end") FROM pairs
UNION ALL SELECT 'group_events', count(*), min(start), max("end") FROM grps UNION ALL SELECT 'group_memberships', count(*), NULL, NULL FROM mems UNION ALL SELECT 'observation_windows', 0, NULL, NULL""")
def src_dataset_summary(spark, sf_dir):
    """SRC-01 to SRC-05: rows and bounds of all five tables."""
    return _dataset(spark, sf_dir).summary()


FOUND = f"""{TABLES}, p AS (SELECT count(*) AS a, count(*) FILTER (source_id = target_id) AS self_loops, count(*) FILTER (source_id IS NULL OR target_id IS NULL) AS missing_endpoints, count(*) FILTER (quality_flag IS NOT NULL) AS exact_duplicate_source_record,
  count(*) FILTER (duration_seconds < 0) AS negative_duration, count(*) FILTER (duration_seconds = 0) AS zero_duration, count(*) FILTER (abs(duration_seconds - ("end" - start) / 1e6) > 1) AS duration_coordinate_mismatch,
  count(*) FILTER ("end" < start) AS reversed_time, count(*) FILTER (start IS NULL OR "end" IS NULL) AS missing_temporal_coordinates, count(*) FILTER (measurement_value IS NULL) AS non_finite_measurement FROM pairs),
g AS (SELECT count(*) AS a, count(*) FILTER (start IS NULL OR "end" IS NULL) AS missing_group_time, count(*) FILTER ("end" < start) AS reversed_group_time, count(*) FILTER (duration_seconds < 0) AS negative_group_duration, count(*) FILTER (duration_seconds = 0) AS zero_group_duration FROM grps),
x AS (
  SELECT unnest(['high', 'critical', 'medium', 'critical', 'medium', 'medium', 'critical', 'high', 'medium']) AS severity, unnest(['self_loops', 'missing_endpoints', 'exact_duplicate_source_record', 'negative_duration', 'zero_duration', 'duration_coordinate_mismatch', 'reversed_time', 'missing_temporal_coordinates', 'non_finite_measurement']) AS code,
         unnest([self_loops, missing_endpoints, exact_duplicate_source_record, negative_duration, zero_duration, duration_coordinate_mismatch, reversed_time, missing_temporal_coordinates, non_finite_measurement]) AS n, unnest([NULL, NULL, a, NULL, a, a, NULL, a, a]) AS a FROM p
  UNION ALL SELECT unnest(['high', 'critical', 'critical', 'medium']), unnest(['missing_group_time', 'reversed_group_time', 'negative_group_duration', 'zero_group_duration']), unnest([missing_group_time, reversed_group_time, negative_group_duration, zero_group_duration]), unnest([NULL, NULL, NULL, a]) FROM g
  UNION ALL SELECT 'high', 'duplicate_node_ids', count(*) - count(DISTINCT node_id), count(*) FROM who UNION ALL SELECT 'critical', 'missing_node_ids', count(*) FILTER (node_id IS NULL), NULL FROM who
  UNION ALL SELECT 'high', 'duplicate_event_ids', count(*) - count(DISTINCT event_id), NULL FROM pairs UNION ALL SELECT 'high', 'duplicate_group_ids', count(*) - count(DISTINCT group_event_id), NULL FROM grps
  UNION ALL SELECT 'high', 'duplicate_group_membership', count(*) - count(DISTINCT group_event_id || chr(31) || node_id), NULL FROM mems
  UNION ALL SELECT 'high', 'orphan_dyadic_nodes', count(*), NULL FROM (SELECT source_id FROM pairs UNION SELECT target_id FROM pairs EXCEPT SELECT node_id FROM who)
  UNION ALL SELECT 'critical', 'orphan_group_ids', count(*), NULL FROM (SELECT group_event_id FROM mems EXCEPT SELECT group_event_id FROM grps) UNION ALL SELECT 'high', 'orphan_group_members', count(*), NULL FROM (SELECT node_id FROM mems EXCEPT SELECT node_id FROM who))
SELECT severity, code, n, round(n / a, 9) AS fraction FROM x"""


@query(FOUND)
def pf_findings(spark, sf_dir):
    """PF-04 to PF-06: all checks of a dataset's tables, by themselves and against each other."""
    return dataset.findings(_dataset(spark, sf_dir)).withColumn("fraction", F.round("fraction", 9))


@query(TABLES + ", s AS (SELECT group_event_id, count(*) AS s FROM mems GROUP BY ALL) SELECT count(*) AS n, min(s) AS least, median(s) AS median, max(s) AS most, round(avg((s = 1)::INT), 9) AS singletons FROM s")
def pf_group_sizes(spark, sf_dir):
    """PF-05: sizes of groups."""
    return dataset.group_sizes(_dataset(spark, sf_dir)).withColumn("singletons", F.round("singletons", 9))


GOOD = """ok AS (SELECT * FROM pairs WHERE quality_flag IS NULL AND "end" > start)"""


@query(TABLES + f""", {GOOD}, d AS (SELECT * FROM ok WHERE measurement_type = 'duration' AND edge_semantics = 'sensor_proximity'),
m AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w THEN 1 ELSE 0 END AS fresh FROM d WINDOW w AS (PARTITION BY source_id, target_id, directed, location_id ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, target_id, directed, location_id ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
x AS (
  SELECT 'duration' AS mapper, 'exposure:' || event_id AS exposure_id, source_id, target_id, start, "end", 1.0::DOUBLE AS rate, event_id AS origin FROM d
  UNION ALL SELECT 'detection', 'exposure:' || event_id, source_id, target_id, start, "end", 1.0, event_id FROM ok WHERE event_representation = 'fixed_bin' AND edge_semantics = 'sensor_proximity'
  UNION ALL SELECT 'association', 'exposure:' || event_id, source_id, target_id, start, "end", measurement_value / (("end" - start) / 1e6), event_id FROM ok WHERE measurement_type = 'association_index'
  UNION ALL SELECT 'coalesced', 'coalesced:' || source_id || ':' || target_id || ':' || min(start), source_id, target_id, min(start), max("end"), 1.0, '[' || string_agg('"' || event_id || '"', ',' ORDER BY start, "end", event_id) || ']' FROM i GROUP BY source_id, target_id, directed, location_id, island)
SELECT mapper, exposure_id, source_id, target_id, start, "end", round(rate, 9) AS rate, origin FROM x""")
def pf_mapped_exposures(spark, sf_dir):
    """PF-09 to PF-12, PF-15, INT-01: pair exposures of each mapper by its name."""
    ds = _dataset(spark, sf_dir)
    out = None
    for name in ("DurationContactMapper", "DetectionIntervalMapper", "AggregatedAssociationMapper", "CoalescedDurationContactMapper"):
        x = streams.compiled(ds, name).pairs
        out = x if out is None else out.unionByName(x)
    return out.select("mapper", "exposure_id", "source_id", "target_id", "start", "end", _r("rate", "rate", 9), "origin")


@query(TABLES + """ SELECT g.group_event_id, start, "end", 1.0::DOUBLE AS rate, 'frequency_dependent' AS mode, count(m.node_id) AS members FROM grps g LEFT JOIN mems m USING (group_event_id) WHERE "end" > start GROUP BY ALL""")
def pf_primary_exposure(spark, sf_dir):
    """PF-13, PF-14: the mapper that the dataset calls for, here groups of positive length."""
    s = streams.primary(_dataset(spark, sf_dir))
    n = s.members.groupBy("group_event_id").agg(F.count("*").alias("members"))
    return s.groups.join(n, "group_event_id", "left").select("group_event_id", "start", "end", "rate", "mode", F.coalesce("members", F.lit(0)).alias("members"))


@query(TABLES + f""", keep AS (SELECT DISTINCT node_id FROM mems WHERE substr(node_id, 2)::BIGINT % 3 = 0), g AS (SELECT group_event_id, greatest(start, {WEEK_2}) AS start, least("end", {WEEK_3 - HOUR // 2}) AS "end" FROM grps WHERE "end" > start AND start < {WEEK_3 - HOUR // 2} AND "end" > {WEEK_2}),
m AS (SELECT * FROM mems JOIN keep USING (node_id) JOIN g USING (group_event_id)), n AS (SELECT group_event_id, count(DISTINCT node_id) AS members FROM m GROUP BY ALL HAVING count(DISTINCT node_id) > 1),
{GOOD}, p AS (SELECT * FROM ok WHERE measurement_type = 'duration' AND edge_semantics = 'sensor_proximity' AND start < {WEEK_3 - HOUR // 2} AND "end" > {WEEK_2} AND source_id IN (FROM keep) AND target_id IN (FROM keep))
SELECT 'group' AS kind, group_event_id AS id, start, "end", members FROM g JOIN n USING (group_event_id) UNION ALL SELECT 'pair', 'exposure:' || event_id, greatest(start, {WEEK_2}), least("end", {WEEK_3 - HOUR // 2}), 2 FROM p""")
def pf_population_slice(spark, sf_dir):
    """PF-16, PF-17, PF-19, SET-01: pairs and groups together, cut to a window and to a population."""
    ds = _dataset(spark, sf_dir)
    keep = ds["group_memberships"].where("cast(substr(node_id, 2) as long) % 3 = 0").select("node_id").distinct()
    s = streams.restricted(streams.sliced(streams.combined(streams.compiled(ds, "duration"), streams.compiled(ds, "group_mixing")), WEEK_2, WEEK_3 - HOUR // 2), keep)
    n = s.members.groupBy("group_event_id").agg(F.count("*").alias("members"))
    groups = s.groups.join(n, "group_event_id").select(F.lit("group").alias("kind"), F.col("group_event_id").alias("id"), "start", "end", "members")
    return groups.union(s.pairs.select(F.lit("pair"), "exposure_id", "start", "end", F.lit(2).cast("long")))


@query(TABLES + """, a AS (SELECT source_id AS node_id, start, "end" FROM pairs UNION ALL SELECT target_id, start, "end" FROM pairs), p AS (SELECT node_id, min(start) AS s, max("end") AS e FROM a GROUP BY ALL),
g AS (SELECT node_id, min(start) AS s, max("end") AS e FROM mems LEFT JOIN grps USING (group_event_id) GROUP BY ALL), w AS (SELECT node_id, min(s) AS s, max(e) AS e FROM (SELECT * FROM p UNION ALL SELECT * FROM g) GROUP BY ALL),
seen AS (SELECT node_id FROM p UNION SELECT node_id FROM g) SELECT node_id, who.node_id IS NOT NULL AS listed, s AS first_observed_at, e AS last_observed_at FROM seen LEFT JOIN who USING (node_id) LEFT JOIN w USING (node_id)""".replace("who.node_id IS NOT NULL AS listed", "node_id IN (FROM who) AS listed").replace("LEFT JOIN who USING (node_id) ", ""))
def jn_observation_bounds(spark, sf_dir):
    """PF-03, JN-01, JN-02: individuals from a roster and all tables, with the bounds of their observation."""
    ds = _dataset(spark, sf_dir)
    windows = dataset.windows_from_pairs(ds).unionByName(dataset.windows_from_groups(ds))
    roster = ds["individuals"].withColumn("group_id", F.lit("listed"))
    x = dataset.with_bounds(dataset.individuals_from(ds, roster), windows)
    return x.select("node_id", F.col("group_id").isNotNull().alias("listed"), "first_observed_at", "last_observed_at")


VARIANTS = f"""{TABLES}, g AS (SELECT group_event_id AS id, start, "end" FROM grps WHERE "end" > start), p AS (SELECT event_id AS id, start, "end" FROM pairs WHERE quality_flag IS NULL AND "end" > start AND measurement_type = 'duration' AND edge_semantics = 'sensor_proximity'),
m AS (SELECT group_event_id AS id, node_id FROM mems), host AS (SELECT node_id FROM who WHERE substr(node_id, 2)::BIGINT % 4 = 1),
v AS (
  SELECT 'replayed' AS variant, 'group' AS kind, id, greatest(start, {WEEK_2 - 3 * DAY}) + {3 * DAY} AS start, least("end", {WEEK_2}) + {3 * DAY} AS "end" FROM g WHERE start < {WEEK_2} AND "end" > {WEEK_2 - 3 * DAY}
  UNION ALL SELECT 'replayed', 'pair', id, greatest(start, {WEEK_2 - 3 * DAY}) + {3 * DAY}, least("end", {WEEK_2}) + {3 * DAY} FROM p WHERE start < {WEEK_2} AND "end" > {WEEK_2 - 3 * DAY}
  UNION ALL SELECT 'hosted', 'group', id, start, "end" FROM g WHERE id IN (SELECT id FROM m WHERE node_id IN (FROM host))
  UNION ALL SELECT 'first', 'group', * FROM (SELECT * FROM g ORDER BY start, id LIMIT 100) UNION ALL SELECT 'first', 'pair', * FROM (SELECT id, start, "end" FROM p ORDER BY start, 'exposure:' || id LIMIT 100)),
e AS (SELECT variant, min(start) AS first, max("end") AS last, count(*) FILTER (kind = 'pair') AS pairs, count(*) FILTER (kind = 'group') AS groups FROM v GROUP BY variant),
n AS (SELECT variant, count(m.node_id) AS members FROM v JOIN m ON v.id = m.id AND v.kind = 'group' WHERE variant <> 'hosted' OR m.node_id IN (FROM host) GROUP BY variant)
SELECT variant, first, last, pairs, groups, members FROM e JOIN n USING (variant)"""


@query(VARIANTS)
def pf_stream_variants(spark, sf_dir):
    """PF-18, PF-23, PF-25, INT-12, INT-25: histories replayed on a horizon, groups of a host species, first events, and their extents."""
    ds = _dataset(spark, sf_dir)
    s = streams.combined(streams.compiled(ds, "duration"), streams.compiled(ds, "group_mixing"))
    host = ds["individuals"].withColumn("species", F.when(F.col("node_id").substr(F.lit(2), F.lit(20)).cast("long") % 4 == 1, "host").otherwise("other"))
    out = None
    for name, v in (("replayed", streams.replayed(s, WEEK_2, WEEK_2 + 3 * DAY)), ("hosted", streams.hosted(s, host, "host")), ("first", streams.first_events(s, 100))):
        count = lambda df, n: df.agg(F.count("*").alias(n))
        x = streams.extent(v).crossJoin(count(v.pairs, "pairs")).crossJoin(count(v.groups, "groups")).crossJoin(count(v.members, "members"))  # one row each
        x = x.select(F.lit(name).alias("variant"), "first", "last", "pairs", "groups", "members")
        out = x if out is None else out.union(x)
    return out


COARSE = f"(greatest(0.0::DOUBLE, {WEEK_3} - (greatest(start, {WEEK_2}) + least(\"end\", {WEEK_3})) / 2.0::DOUBLE))"


@query(f"""SELECT source_id, round(sum((least("end", {WEEK_3}) - greatest(start, {WEEK_2})) * pow(0.5, {COARSE} / {2 * DAY}.0::DOUBLE) / 1e6), 3) AS fine,
round(sum((least("end", {WEEK_3}) - greatest(start, {WEEK_2})) * pow(0.5, ceil({COARSE} / {DAY}) * {DAY} / {2 * DAY}.0::DOUBLE) / 1e6), 3) AS coarse FROM dyads WHERE start < {WEEK_3} AND "end" > {WEEK_2} GROUP BY source_id""")
def st_coarse_scores(spark, sf_dir):
    """INT-11, ST-12: contact before an anchor that halves every two days, with exact ages and with ages in whole days."""
    d = canonical.dyads(spark, sf_dir).where((F.col("start") < WEEK_3) & (F.col("end") > WEEK_2))
    of = lambda grain: intervals.coarse_decayed(F.col("start"), F.col("end"), WEEK_2, WEEK_3, 2.0 * DAY, grain) / 1e6
    return d.groupBy("source_id").agg(_r(F.sum(of(0)), "fine", 3), _r(F.sum(of(DAY)), "coarse", 3))


FEATURE = ["activity_count", "event_rate_per_day", "contact_opportunity_rate", "weighted_exposure_rate", "eligible_partner_fraction", "observed_partner_count", "location_count", "mean_group_size", "recency_score", "recent_activity_fraction", "active_span_fraction"]


@query(TABLES + f""", {GOOD}, ev AS (
  SELECT 'p' || event_id AS event, start, "end", location_id FROM ok WHERE measurement_type = 'duration' AND edge_semantics = 'sensor_proximity' AND source_id <> target_id
  UNION ALL SELECT 'g' || group_event_id, start, "end", NULL FROM grps WHERE "end" > start),
mem AS (SELECT 'p' || event_id AS event, unnest([source_id, target_id]) AS node FROM pairs WHERE source_id <> target_id UNION SELECT 'g' || group_event_id, node_id FROM mems),
sz AS (SELECT event, count(*) AS n FROM mem GROUP BY ALL HAVING count(*) > 1), c AS (SELECT unnest(range({ORIGIN}, {ORIGIN} + 4 * {WEEK}, {WEEK})) AS begin), l AS (SELECT begin, node_id AS node FROM c, who),
h AS (SELECT begin, event, n, location_id, least("end", begin + {WEEK}) AS moment, (least("end", begin + {WEEK}) - greatest(start, begin)) / 1e6 AS seconds FROM ev JOIN sz USING (event) JOIN c ON start < begin + {WEEK} AND "end" > begin),
r AS (SELECT h.*, node FROM h JOIN mem USING (event)), s AS (
  SELECT begin, node, count(*) AS a, sum(seconds * (n - 1)) AS o, sum(seconds) AS x, sum(n) AS g, count(DISTINCT location_id) AS loc, min(moment) AS f, max(moment) AS t, count(*) FILTER (moment >= begin + {WEEK // 2}) AS rec FROM r GROUP BY ALL),
q AS (SELECT r.begin, r.node, count(DISTINCT m.node) AS partners, count(DISTINCT m.node) FILTER (m.node IN (FROM who)) AS fit FROM r JOIN mem m ON m.event = r.event AND m.node <> r.node GROUP BY ALL), n AS (SELECT count(*) AS n FROM who)
SELECT l.begin, l.node, coalesce(a, 0) AS activity_count, round(coalesce(a, 0) * 86400 / {WEEK / 1e6}, 9) AS event_rate_per_day, round(coalesce(o, 0) / {WEEK / 1e6}, 9) AS contact_opportunity_rate, round(coalesce(x, 0) / {WEEK / 1e6}, 9) AS weighted_exposure_rate,
  round(coalesce(fit, 0) / greatest(n.n - 1, 1), 9) AS eligible_partner_fraction, coalesce(partners, 0) AS observed_partner_count, coalesce(loc, 0) AS location_count, round(coalesce(g / a, 0), 9) AS mean_group_size,
  round(greatest(0, 1 - (l.begin + {WEEK} - coalesce(t, l.begin)) / {float(WEEK)}::DOUBLE), 9) AS recency_score, round(coalesce(rec / a, 0), 9) AS recent_activity_fraction, round(CASE WHEN a > 1 THEN (t - f) / {float(WEEK)}::DOUBLE ELSE 0 END, 9) AS active_span_fraction
FROM l LEFT JOIN s ON s.begin = l.begin AND s.node = l.node LEFT JOIN q ON q.begin = l.begin AND q.node = l.node, n""")
def agg_stream_features(spark, sf_dir):
    """AGG-05 to AGG-09, INT-09: features of each listed node before four anchors, from pairs and groups."""
    ds = _dataset(spark, sf_dir)
    s = streams.combined(streams.compiled(ds, "duration"), streams.compiled(ds, "group_mixing"))
    pairs = s.pairs.where("source_id <> target_id")
    name = lambda p, c: F.concat(F.lit(p), F.col(c)).alias("event")
    events = pairs.select(name("p", "origin"), "start", "end", "rate", "location_id").union(s.groups.select(name("g", "group_event_id"), "start", "end", "rate", "location_id")).withColumn("network", F.lit("all"))
    members = pairs.select(name("p", "origin"), F.explode(F.array("source_id", "target_id")).alias("node")).union(s.members.select(name("g", "group_event_id"), F.col("node_id").alias("node")))
    begin = F.explode(F.array(*(F.lit(ORIGIN + k * WEEK) for k in range(4)))).alias("begin")
    labels = ds["individuals"].select(F.col("node_id").alias("node"), begin, F.lit("all").alias("network")).withColumn("anchor", F.col("begin") + WEEK)
    x = history.stream_features(events, members, labels, DAY)
    whole = {"activity_count", "observed_partner_count", "location_count"}
    return x.select("begin", "node", *(F.col(c) if c in whole else _r(c, c, 9) for c in FEATURE))


LABELS = f"""+ l AS (SELECT kind || ':' || week || ':' || source_id AS label_id, kind AS network_id, week, source_id AS candidate_id, {ORIGIN} + week * {WEEK} AS history_start, {ORIGIN} + (week + 1) * {WEEK} AS anchor_time,
  {ORIGIN} + (week + CASE WHEN source_id % 40 = 9 THEN 1 ELSE 2 END) * {WEEK} AS horizon_end, CASE WHEN source_id % 30 <> 4 THEN round(w / 300 - 0.5, 6) END AS value, 0.5::DOUBLE AS share FROM (SELECT kind, source_id, (start - {ORIGIN}) // {WEEK} AS week, sum(weight) AS w FROM dyads GROUP BY ALL)),
labels_of AS (SELECT *, count(*) OVER (PARTITION BY network_id, week) + CASE WHEN week = 2 THEN 1 ELSE 0 END AS eligible_population FROM l)"""


@query(LABELS + """, c AS (SELECT count(DISTINCT candidate_id) AS c, min(eligible_population) AS p FROM labels_of GROUP BY network_id, week)
SELECT 'no_missing_values' AS "check", count(*) FILTER (value IS NULL) AS n FROM labels_of UNION ALL SELECT 'strict_time_order', count(*) FILTER (NOT (history_start < anchor_time AND anchor_time < horizon_end)) FROM labels_of
UNION ALL SELECT 'value_ranges', count(*) FILTER (NOT (value BETWEEN -1 AND 1 AND share BETWEEN 0 AND 1)) FROM labels_of UNION ALL SELECT 'unique_label_id', count(*) - count(DISTINCT label_id) FROM labels_of
UNION ALL SELECT 'complete_candidate_coverage', count(*) FROM c WHERE c <> p""")
def pf_label_checks(spark, sf_dir):
    """PF-21, PF-22: rules of model-ready labels, and how many rows or contexts break them."""
    d = canonical.dyads(spark, sf_dir).withColumn("week", F.floor((F.col("start") - ORIGIN) / WEEK))
    at = lambda k: ORIGIN + (F.col("week") + k) * WEEK
    x = d.groupBy("kind", "week", "source_id").agg(F.round(F.sum("weight") / 300 - 0.5, 6).alias("value"))
    x = x.select(
        F.concat_ws(":", "kind", "week", "source_id").alias("label_id"), F.col("kind").alias("network_id"), "week", F.col("source_id").alias("candidate_id"), at(0).alias("history_start"), at(1).alias("anchor_time"),
        F.when(F.col("source_id") % 40 == 9, at(1)).otherwise(at(2)).alias("horizon_end"), F.when(F.col("source_id") % 30 != 4, F.col("value")).alias("value"), F.lit(0.5).alias("share"))
    n = x.groupBy("network_id", "week").agg(F.count("*").alias("n")).select("network_id", "week", (F.col("n") + F.when(F.col("week") == 2, 1).otherwise(0)).alias("eligible_population"))
    n = history.constant_by_key(n, ["network_id", "week"], ["eligible_population"])
    return history.label_checks(x.join(n, ["network_id", "week"]), ["network_id", "week"], "candidate_id", "label_id", "eligible_population", "value", "share", ("history_start", "anchor_time", "horizon_end"))
