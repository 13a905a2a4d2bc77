"""Queries of factorial parts, retention, support in histories, subsets and chosen sets, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators import intervals, policies, structure
from tidewater.plans.catalogue import DAY, HOUR, ORIGIN, WEEK, _r, query
from tidewater.sources import canonical

CONTEXT = ["kind", "week"]
TERMS = ["early", "long", "early x long", "even", "early x even", "long x even", "early x long x even"]
SIGNS = {"early": "(CASE WHEN early THEN 1 ELSE -1 END)", "long": "(CASE WHEN long THEN 1 ELSE -1 END)", "even": "(CASE WHEN even THEN 1 ELSE -1 END)"}


@query(f"""+ cells AS (SELECT kind, source_id % 20 AS family, start % {DAY} < {12 * HOUR} AS early, "end" - start > {HOUR // 2} AS long, event_id % 2 = 0 AS even, avg(weight) AS y FROM dyads GROUP BY ALL),
n AS (SELECT kind, count(*) = 8 * count(DISTINCT family) AS balanced, avg(y) AS m, sum(y * y) - sum(y) ** 2 / count(*) AS total FROM cells GROUP BY kind),
f AS (SELECT kind, sum(8 * (fm - m) ** 2) AS ss FROM (SELECT kind, family, avg(y) AS fm FROM cells GROUP BY ALL) JOIN n USING (kind) GROUP BY kind),
t AS (SELECT kind, unnest([{', '.join(repr(t) for t in TERMS)}]) AS component, unnest([{', '.join('sum(y * ' + ' * '.join(SIGNS[p] for p in t.split(' x ')) + ') ** 2 / count(*)' for t in TERMS)}]) AS ss FROM cells GROUP BY kind),
p AS (SELECT kind, 'family' AS component, ss FROM f UNION ALL SELECT * FROM t UNION ALL SELECT kind, 'residual', greatest(any_value(total) - sum(x.ss), 0) FROM n JOIN (SELECT kind, ss FROM f UNION ALL SELECT kind, ss FROM t) x USING (kind) GROUP BY kind)
SELECT kind, component, CASE WHEN balanced THEN round(ss, 4) END AS sum_squares, CASE WHEN balanced THEN round(ss / total, 6) END AS share, balanced FROM p JOIN n USING (kind)""")
def agg_factorial(spark, sf_dir):
    """AGG-19: families, three factors with two levels, their interactions and what is left."""
    d = canonical.dyads(spark, sf_dir)
    factors = {"early": F.col("start") % DAY < 12 * HOUR, "long": F.col("end") - F.col("start") > HOUR // 2, "even": F.col("event_id") % 2 == 0}
    cells = d.groupBy("kind", (F.col("source_id") % 20).alias("family"), *(c.alias(n) for n, c in factors.items())).agg(F.avg("weight").alias("y"))
    x = structure.factorial_parts(cells, ["kind"], "family", {n: F.col(n) for n in factors}, "y")
    return x.select("kind", "component", _r("sum_squares", "sum_squares", 4), _r("share", "share"), "balanced")


PARTS = f"""+ p AS (SELECT DISTINCT kind, (start - {ORIGIN}) // {WEEK} AS week FROM dyads),
w AS (SELECT kind, week, {ORIGIN} + week * {WEEK} AS low, {ORIGIN} + (week + 1) * {WEEK} AS high FROM p),
parts AS (
  SELECT kind, week, 'first' AS part, low AS s, low + {WEEK // 2} AS e FROM w UNION ALL SELECT kind, week, 'second', low + {WEEK // 2}, high FROM w UNION ALL SELECT kind, week, 'future', high, high + {WEEK} FROM w),
edges AS (SELECT p.kind, p.week, part, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, round(sum((least("end", e) - greatest(start, s)) / 1e6), 6) AS w
  FROM parts p JOIN dyads d ON d.kind = p.kind AND d.start < p.e AND d."end" > p.s WHERE source_id <> target_id GROUP BY ALL),
nodes AS (SELECT DISTINCT kind, week, unnest([a, b]) AS node FROM edges WHERE part <> 'future'),
inner_edges AS (SELECT e.* FROM edges e JOIN nodes x ON e.kind = x.kind AND e.week = x.week AND e.a = x.node JOIN nodes y ON e.kind = y.kind AND e.week = y.week AND e.b = y.node)"""


def _retention_sql(left: str, right: str, what: str) -> str:
    key = "kind, week"
    return f"""{what}_l AS ({left}), {what}_r AS ({right}), {what}_j AS (SELECT {key}, a, b, l.w AS l, r.w AS r FROM {what}_l l FULL JOIN {what}_r r USING ({key}, a, b)),
{what}_s AS (SELECT {key}, count(l) AS le, count(r) AS re, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS shared, count(*) AS u, sum(coalesce(l, 0) * coalesce(r, 0)) AS dot, sum(coalesce(l, 0) ** 2) AS ll, sum(coalesce(r, 0) ** 2) AS rr FROM {what}_j GROUP BY ALL),
{what}_e AS (SELECT {key}, unnest([a, b]) AS node, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM {what}_j), {what}_n AS (SELECT {key}, node, coalesce(round(sum(l), 9), 0) AS l, coalesce(round(sum(r), 9), 0) AS r FROM nodes LEFT JOIN {what}_e USING ({key}, node) GROUP BY ALL),
{what}_k AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY l) + (count(*) OVER (PARTITION BY {key}, l) - 1) / 2.0::DOUBLE AS lr, rank() OVER (PARTITION BY {key} ORDER BY r) + (count(*) OVER (PARTITION BY {key}, r) - 1) / 2.0::DOUBLE AS rr,
  row_number() OVER (PARTITION BY {key} ORDER BY l DESC, node) AS lp, row_number() OVER (PARTITION BY {key} ORDER BY r DESC, node) AS rp, count(*) OVER (PARTITION BY {key}) AS n, greatest(1, ceil(count(*) OVER (PARTITION BY {key}) * 0.1::DOUBLE)) AS k FROM {what}_n),
{what}_t AS (SELECT {key}, max(n) AS n, max(k) AS k, CASE WHEN min(lr) < max(lr) AND min(rr) < max(rr) THEN corr(lr, rr) ELSE 0 END AS persistence, count(*) FILTER (lp <= k AND rp <= k) AS top FROM {what}_k GROUP BY ALL),
{what}_x AS (SELECT t.*, coalesce(le, 0) AS le, coalesce(re, 0) AS re, coalesce(shared, 0) AS shared, coalesce(u, 0) AS u, coalesce(dot, 0) AS dot, coalesce(ll, 0) AS ll, coalesce(s.rr, 0) AS rr2, CASE WHEN n > 1 THEN coalesce(le, 0) * coalesce(re, 0) / (n * (n - 1) / 2.0::DOUBLE) ELSE 0 END AS expected FROM {what}_t t LEFT JOIN {what}_s s USING ({key}))"""


def _retention_out(what: str) -> str:
    return f"""SELECT kind, week, '{what}' AS comparison, n, round(CASE WHEN least(le, re) - expected > 1e-12 THEN (shared - expected) / (least(le, re) - expected) ELSE 0 END, 9) + 0.0::DOUBLE AS adjusted, least(le, re) - expected > 1e-12 AS estimable,
  round(CASE WHEN u > 0 THEN shared / u ELSE 1 END, 9) AS jaccard, round(CASE WHEN ll > 0 AND rr2 > 0 THEN dot / (sqrt(ll) * sqrt(rr2)) ELSE 0 END, 9) AS cosine, round(persistence, 9) + 0.0::DOUBLE AS rank_persistence, round(top / k, 9) AS top_overlap, le AS left_edges, re AS right_edges, shared FROM {what}_x"""


@query(PARTS + ", " + _retention_sql("SELECT * FROM inner_edges WHERE part = 'first'", "SELECT * FROM inner_edges WHERE part = 'second'", "halves") + ", " + _retention_sql(
    "SELECT kind, week, a, b, sum(w) AS w FROM inner_edges WHERE part <> 'future' GROUP BY ALL", "SELECT * FROM inner_edges WHERE part = 'future'", "future") + " " + _retention_out("halves") + " UNION ALL " + _retention_out("future"))
def set_edge_retention(spark, sf_dir):
    """SET-02, SET-04: contacts of a week's first half in its second, and of the week in the next one, beyond chance."""
    d = canonical.dyads(spark, sf_dir).where("source_id <> target_id")
    low = ORIGIN + F.col("week") * WEEK
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("part"), (low + a).alias("s"), (low + b).alias("e")) for n, a, b in (("first", 0, WEEK // 2), ("second", WEEK // 2, WEEK), ("future", WEEK, 2 * WEEK))))).alias("x")
    w = canonical.dyads(spark, sf_dir).select("kind", F.floor((F.col("start") - ORIGIN) / WEEK).alias("week")).distinct().select("kind", "week", parts).select("kind", "week", "x.part", "x.s", "x.e")
    d = d.select("kind", "source_id", "target_id", "start", "end", F.greatest("end", F.col("start") + 1).alias("until"))  # contacts without length are edges of weight 0
    met = intervals.range_join(d, w, ["kind"], ("start", "until"), ("s", "e"), DAY).where("start < e and end > s")
    edges = met.groupBy(*CONTEXT, "part", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.round(F.sum((F.least("end", "e") - F.greatest("start", "s")) / 1e6), 6).alias("w"))
    nodes = edges.where("part <> 'future'").select(*CONTEXT, F.explode(F.array("a", "b")).alias("node")).distinct()
    for c in ("a", "b"):
        edges = edges.join(nodes.withColumnRenamed("node", c), [*CONTEXT, c], "left_semi")
    history = edges.where("part <> 'future'").groupBy(*CONTEXT, "a", "b").agg(F.sum("w").alias("w"))
    of = lambda part: edges.where(F.col("part") == part)
    halves = structure.retention(of("first"), of("second"), nodes, CONTEXT, 0.1).withColumn("comparison", F.lit("halves"))
    future = structure.retention(history, of("future"), nodes, CONTEXT, 0.1).withColumn("comparison", F.lit("future"))
    x = halves.unionByName(future)
    return x.select(*CONTEXT, "comparison", "n", _r("adjusted", "adjusted", 9), "estimable", *(_r(c, c, 9) for c in ("jaccard", "cosine", "rank_persistence", "top_overlap")), "left_edges", "right_edges", "shared")


@query(f"""+ w AS (SELECT DISTINCT kind, {ORIGIN} + (start - {ORIGIN}) // {WEEK} * {WEEK} AS low FROM dyads), n AS (SELECT DISTINCT kind, source_id AS node FROM dyads), c AS (SELECT kind, node, low, low + {WEEK} AS high FROM w JOIN n USING (kind)),
o AS (SELECT kind, source_id AS node, start, "end" FROM dyads UNION ALL SELECT kind, target_id, start, "end" FROM dyads),
t AS (SELECT c.kind, c.node, c.low, min(greatest(start, low)) AS a, max(least("end", high)) AS b FROM c JOIN o ON c.kind = o.kind AND c.node = o.node AND start < high AND "end" > low AND "end" > start GROUP BY ALL),
h AS (SELECT DISTINCT node_id AS node, start, start + {HOUR} AS "end" FROM memberships), v AS (SELECT c.kind, c.node, c.low, sum(least("end", high) - greatest(start, low)) AS covered FROM c JOIN h ON c.node = h.node AND start < high AND "end" > low GROUP BY ALL)
SELECT c.kind, c.node, c.low AS history_start, round((a - c.low) / {WEEK}, 9) AS first_seen, round((high - b) / {WEEK}, 9) AS last_gap, round((b - a) / {WEEK}, 9) AS span, round(coalesce(covered, 0) / {WEEK}, 9) AS roster
FROM c LEFT JOIN t ON c.kind = t.kind AND c.node = t.node AND c.low = t.low LEFT JOIN v ON c.kind = v.kind AND c.node = v.node AND c.low = v.low""")
def jn_history_support(spark, sf_dir):
    """JN-31: when in its history each candidate was first and last seen, and how much of it the roster covers."""
    d = canonical.dyads(spark, sf_dir)
    w = d.select("kind", (ORIGIN + F.floor((F.col("start") - ORIGIN) / WEEK) * WEEK).alias("low")).distinct().withColumn("high", F.col("low") + WEEK)
    c = w.join(d.select("kind", F.col("source_id").alias("node")).distinct(), "kind")
    seen = d.select("kind", F.explode(F.array("source_id", "target_id")).alias("node"), "start", "end")
    hours = canonical.memberships(spark, sf_dir).select(F.col("node_id").alias("node"), "start", (F.col("start") + HOUR).alias("end")).distinct()
    t = intervals.coverage_of(seen, c, ["kind", "node"], ("start", "end"), ("low", "high"), DAY)
    v = intervals.coverage_of(hours, c.select("node", "low", "high").distinct(), ["node"], ("start", "end"), ("low", "high"), DAY)
    x = c.join(t.drop("covered"), ["kind", "node", "low", "high"]).join(v.drop("first", "last"), ["node", "low", "high"])
    share = lambda v, name: _r(v / WEEK, name, 9)
    return x.select("kind", "node", F.col("low").alias("history_start"), share(F.col("first") - F.col("low"), "first_seen"), share(F.col("high") - F.col("last"), "last_gap"), share(F.col("last") - F.col("first"), "span"), share(F.col("covered"), "roster"))


POOLS = f"""+ e AS (SELECT kind, (start - {ORIGIN}) // {WEEK} AS week, (start - {ORIGIN}) // {DAY} AS day, source_id AS a, target_id AS b FROM dyads WHERE source_id <> target_id),
ends AS (SELECT kind, week, day, a AS node, b AS partner FROM e UNION ALL SELECT kind, week, day, b, a FROM e),
c AS (SELECT kind, week, node, count(*) AS n FROM ends GROUP BY ALL), pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, week ORDER BY n DESC, node) AS p FROM c) WHERE p <= 5),
bits AS (SELECT kind, week, node, 1 << (row_number() OVER (PARTITION BY kind, week ORDER BY node) - 1) AS bit FROM pool), full_mask AS (SELECT kind, week, sum(bit)::BIGINT AS m FROM bits GROUP BY ALL),
sets AS (SELECT kind, week, mask FROM (SELECT kind, week, unnest(range(m + 1)) AS mask FROM full_mask) WHERE bit_count(mask) <= 2)"""


def _pools(spark, sf_dir):
    d = canonical.dyads(spark, sf_dir).where("source_id <> target_id").withColumns({"week": F.floor((F.col("start") - ORIGIN) / WEEK), "day": F.floor((F.col("start") - ORIGIN) / DAY)})
    both = F.explode(F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("partner")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("partner")))).alias("x")
    ends = d.select(*CONTEXT, "day", both).select(*CONTEXT, "day", "x.node", "x.partner")
    n = ends.groupBy(*CONTEXT, "node").agg(F.count("*").alias("n"))
    return d, ends, ranks.first_k(n, CONTEXT, [F.desc("n"), F.col("node")], 5).select(*CONTEXT, "node")


@query(POOLS + """ SELECT s.kind, s.week, s.mask, bit_count(s.mask)::INT AS size, coalesce(string_agg(node::VARCHAR, '|' ORDER BY node), '') AS items FROM sets s LEFT JOIN bits b ON s.kind = b.kind AND s.week = b.week AND (s.mask & b.bit) <> 0 GROUP BY ALL""")
def rk_subsets(spark, sf_dir):
    """RK-19: all subsets of up to two of each context's five busiest nodes."""
    _, _, pool = _pools(spark, sf_dir)
    return structure.subsets(pool, CONTEXT, "node", 2).select(*CONTEXT, "mask", "size", F.array_join(F.transform("items", lambda v: v.cast("string")), "|").alias("items"))


@query(POOLS + """, met AS (SELECT kind, week, day, partner, bit_or(bit) AS m FROM ends JOIN bits USING (kind, week, node) GROUP BY ALL),
pairs AS (SELECT e.kind, e.week, e.day, x.bit | y.bit AS m FROM e JOIN bits x ON e.kind = x.kind AND e.week = x.week AND e.a = x.node JOIN bits y ON e.kind = y.kind AND e.week = y.week AND e.b = y.node),
v AS (SELECT kind, week, day, mask, sum(v) AS v FROM (
  SELECT s.kind, s.week, day, mask, ((m & mask) <> 0)::INT::DOUBLE AS v FROM sets s JOIN met USING (kind, week)
  UNION ALL SELECT s.kind, s.week, day, mask, CASE WHEN (m & mask) = m THEN 3 ELSE 0 END FROM sets s JOIN pairs USING (kind, week)) GROUP BY ALL),
blocks AS (SELECT kind, week, day, (row_number() OVER (PARTITION BY kind, week ORDER BY day) - 1 >= count(*) OVER (PARTITION BY kind, week) // 2)::INT AS half FROM (SELECT DISTINCT kind, week, day FROM v)),
m AS (SELECT kind, week, mask, coalesce(avg(v) FILTER (half = 0), 0) AS v0, coalesce(avg(v) FILTER (half = 1), 0) AS v1 FROM v JOIN blocks USING (kind, week, day) GROUP BY ALL),
q AS (SELECT s.kind, s.week, s.mask, coalesce(v0, 0) AS v0, coalesce(v1, 0) AS v1 FROM sets s LEFT JOIN m USING (kind, week, mask)),
t AS (SELECT c.kind, c.week, (a.v0 - z.v0) - (c.v0 - b.v0) AS g0, (a.v1 - z.v1) - (c.v1 - b.v1) AS g1 FROM q c JOIN q a ON a.kind = c.kind AND a.week = c.week AND bit_count(a.mask) = 1 AND (a.mask & c.mask) <> 0
  JOIN q b ON b.kind = c.kind AND b.week = c.week AND b.mask = c.mask - a.mask JOIN q z ON z.kind = c.kind AND z.week = c.week AND z.mask = 0 WHERE bit_count(c.mask) = 2),
g AS (SELECT kind, week, count(*) AS inequalities, count(*) FILTER (g0 < 0 AND g1 < 0) AS replicated, coalesce(avg((g0 + g1) / 2) FILTER (g0 < 0 AND g1 < 0), 0) AS margin FROM t GROUP BY ALL)
SELECT s.kind, s.week, coalesce(inequalities, 0) AS inequalities, coalesce(replicated, 0) AS replicated, round(replicated / inequalities, 9) AS rate, round(margin, 9) + 0.0::DOUBLE AS mean_margin FROM (SELECT DISTINCT kind, week FROM sets) s LEFT JOIN g USING (kind, week)""")
def ml_structure_violations(spark, sf_dir):
    """ML-32: whether adding a node gains more beside another one than alone, in both halves of a context's days."""
    d, ends, pool = _pools(spark, sf_dir)
    sets = structure.subsets(pool, CONTEXT, "node", 2)
    bits = sets.where("size = 1").select(*CONTEXT, F.get("items", F.lit(0)).alias("node"), F.col("mask").alias("bit"))
    met = ends.join(bits, [*CONTEXT, "node"]).groupBy(*CONTEXT, "day", "partner").agg(F.bit_or("bit").alias("m")).select(*CONTEXT, "day", "m", F.lit(False).alias("inside"))
    of = lambda c, name: bits.select(*CONTEXT, F.col("node").alias(c), F.col("bit").alias(name))
    pairs = d.select(*CONTEXT, "day", "source_id", "target_id").join(of("source_id", "x"), [*CONTEXT, "source_id"]).join(of("target_id", "y"), [*CONTEXT, "target_id"]).select(*CONTEXT, "day", F.col("x").bitwiseOR(F.col("y")).alias("m"), F.lit(True).alias("inside"))
    worth = met.union(pairs).groupBy(*CONTEXT, "day", "m", "inside").agg(F.count("*").alias("c")).join(sets.select(*CONTEXT, "mask"), CONTEXT)
    common = F.col("m").bitwiseAND(F.col("mask"))
    v = worth.groupBy(*CONTEXT, F.col("day").alias("block"), "mask").agg(F.sum(F.col("c") * F.when(F.col("inside"), F.when(common == F.col("m"), 3.0).otherwise(0.0)).otherwise((common != 0).cast("double"))).alias("value"))
    x = structure.violations(v, sets.select(*CONTEXT, "mask", "size"), CONTEXT)
    return x.select(*CONTEXT, "inequalities", "replicated", _r("rate", "rate", 9), _r("mean_margin", "mean_margin", 9))


RINGS = f"""+ e AS (SELECT kind, (start - {ORIGIN}) // {WEEK} AS week, source_id AS a, target_id AS b, start, "end" FROM dyads WHERE source_id <> target_id),
ends AS (SELECT kind, week, a AS node, b AS partner, start, "end" FROM e UNION ALL SELECT kind, week, b, a, start, "end" FROM e),
contacts AS (SELECT kind, week, node, partner, round(sum(("end" - start) / 1e6), 6) AS past_weight,
  round(sum(("end" - start) / 1e6 * pow(0.5, ({ORIGIN} + (week + 1) * {WEEK} - (start + "end") / 2.0::DOUBLE) / {2 * DAY}.0::DOUBLE)), 6) AS past_recent FROM ends GROUP BY ALL),
eligible AS (SELECT kind, week, node, count(*) AS stable FROM contacts GROUP BY ALL), cases AS (SELECT kind, week, node AS "case" FROM eligible WHERE node % 10 = 3)"""


def _contacts(spark, sf_dir):
    d = canonical.dyads(spark, sf_dir).where("source_id <> target_id").withColumn("week", F.floor((F.col("start") - ORIGIN) / WEEK))
    both = F.explode(F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("partner")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("partner")))).alias("x")
    ends = d.select(*CONTEXT, both, "start", "end").select(*CONTEXT, "x.node", "x.partner", "start", "end")
    anchor = ORIGIN + (F.col("week") + 1) * WEEK
    return ends.groupBy(*CONTEXT, "node", "partner").agg(
        F.round(F.sum((F.col("end") - F.col("start")) / 1e6), 6).alias("past_weight"), F.round(F.sum(intervals.decayed(F.col("start"), F.col("end"), anchor, 2.0 * DAY) / 1e6), 6).alias("past_recent"))


def _ring_sql(method: str, budget: int, seed: int) -> str:
    return f"""SELECT kind, week, "case", '{method}' AS method, node, p::INT AS position FROM (
  SELECT c.kind, c.week, c."case", e.node, row_number() OVER (PARTITION BY c.kind, c.week, c."case" ORDER BY coalesce({method}, 0) > 0 DESC, coalesce({method}, 0) DESC, stable DESC, sha256('{seed}' || chr(31) || '{method}' || chr(31) || 'ties' || chr(31) || e.node), e.node) AS p
  FROM cases c JOIN eligible e ON c.kind = e.kind AND c.week = e.week AND c."case" <> e.node LEFT JOIN contacts x ON x.kind = c.kind AND x.week = c.week AND x.node = c."case" AND x.partner = e.node) WHERE p <= {budget}"""


@query(RINGS + " " + _ring_sql("past_weight", 12, 5) + " UNION ALL " + _ring_sql("past_recent", 12, 5))
def rk_case_rings(spark, sf_dir):
    """RK-11: the twelve nodes around each case by all past contact and by recent contact, for all contexts and cases at once."""
    contacts = _contacts(spark, sf_dir)
    eligible = contacts.groupBy(*CONTEXT, "node").agg(F.count("*").alias("stable"))
    cases = eligible.where("node % 10 = 3").select(*CONTEXT, F.col("node").alias("case"))
    return structure.case_rings(contacts, eligible, cases, CONTEXT, {"past_weight": "past_weight", "past_recent": "past_recent"}, 12, 5)


def _greedy_sql(budget: int, seed: int) -> str:
    sql = RINGS
    for k in range(1, budget + 1):
        chosen = " UNION ALL ".join(f"SELECT kind, week, node FROM b{j}" for j in range(1, k)) or "SELECT kind, week, node FROM contacts WHERE false"
        sql += f""", chosen{k} AS ({chosen}), cover{k} AS (SELECT c.kind, c.week, c.partner AS v, max(past_weight) AS c FROM contacts c JOIN chosen{k} x USING (kind, week, node) GROUP BY ALL),
gain{k} AS (SELECT kind, week, c.node, round(sum(CASE WHEN (kind, week, c.partner) IN (SELECT (kind, week, node) FROM chosen{k}) THEN 0 ELSE greatest(0, past_weight - coalesce(v.c, 0)) END), 6) AS g FROM contacts c LEFT JOIN (SELECT kind, week, v AS partner, c FROM cover{k}) v USING (kind, week, partner)
  WHERE (kind, week, c.node) NOT IN (SELECT (kind, week, node) FROM chosen{k}) GROUP BY ALL),
b{k} AS (SELECT kind, week, node FROM (SELECT *, row_number() OVER (PARTITION BY kind, week ORDER BY g DESC, sha256('{seed}' || chr(31) || 'history_coverage_ties' || chr(31) || node), node) AS p FROM gain{k}) WHERE p = 1)"""
    return sql + " " + " UNION ALL ".join(f"SELECT kind, week, node, {k} AS position FROM b{k}" for k in range(1, budget + 1))


@query(_greedy_sql(3, 5))
def rk_greedy_sets(spark, sf_dir):
    """RK-11, RK-15: three nodes that in turn cover most of the others' contact, in all contexts at once."""
    w = _contacts(spark, sf_dir).select(*CONTEXT, "node", "partner", F.col("past_weight").alias("w"))
    return policies.greedy_sets(w, CONTEXT, 3, 5)
