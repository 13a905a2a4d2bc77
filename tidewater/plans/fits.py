"""Queries of fits that look back, curves on a grid and nested bootstraps, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators import curves, forward, policies, resampling
from tidewater.plans.catalogue import DAY, HOUR, ORIGIN, WEEK, _r, query
from tidewater.sources import canonical

SETS = {"static": ["b"], "current": ["a", "b"], "hybrid": ["a", "b", "stable", "o", "known"]}
TARGETS = ["q", "y"]


def _pct(column: str, name: str) -> str:
    return f"(rank() OVER (PARTITION BY kind, net, day ORDER BY {column}) + (count(*) OVER (PARTITION BY kind, net, day, {column}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY kind, net, day) AS {name}"


DAYS = f"""+ f AS (
  SELECT kind, source_id % 3 AS net, (start - {ORIGIN}) // {DAY} AS day, source_id AS node, count(*) AS n, count(DISTINCT target_id) AS p, round(sum(weight), 6) AS y FROM dyads GROUP BY ALL),
r AS (SELECT *, {_pct('n', 'a')}, {_pct('p', 'b')}, {_pct('y', 'q')} FROM f),
s AS (SELECT *, coalesce(avg(q) OVER past, 0.5) AS stable, count(*) OVER past AS seen FROM r WINDOW past AS (PARTITION BY kind, node ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, {_pct('seen', 'o')}, (seen > 0)::INT AS known FROM s)"""


def _days(spark, sf_dir):
    d = canonical.dyads(spark, sf_dir)
    f = d.groupBy("kind", (F.col("source_id") % 3).alias("net"), F.floor((F.col("start") - ORIGIN) / DAY).alias("day"), F.col("source_id").alias("node")).agg(
        F.count("*").alias("n"), F.countDistinct("target_id").alias("p"), F.round(F.sum("weight"), 6).alias("y"))
    of = ["kind", "net", "day"]
    for c, name in (("n", "a"), ("p", "b"), ("y", "q")):
        f = ranks.average_rank(f, c, of, name, share=True)
    f = policies.prior_history(f, ["kind"], "node", "day", "q", "y")
    return ranks.average_rank(f, "observations", of, "o", share=True).withColumn("known", (F.col("observations") > 0).cast("int"))


def _fits_sql(least: int, alpha: float) -> str:
    """Running sums of products and Gauss' elimination, written out for each set."""
    names = ["1", *dict.fromkeys(c for s in SETS.values() for c in s)]
    products = [(f"m{i}_{j}", f"{names[i]} * {names[j]}") for i in range(len(names)) for j in range(i, len(names))]
    products += [(f"r{i}_{t}", f"{c} * {t}") for i, c in enumerate(names) for t in TARGETS]
    sql = DAYS + f""", c AS (SELECT kind, day, net, {', '.join(f'avg(({v})::DOUBLE) AS {n}' for n, v in products)} FROM x GROUP BY ALL),
t AS (SELECT kind, day, count(*) AS contexts, {', '.join(f'sum({n}) AS {n}' for n, _ in products)} FROM c GROUP BY ALL),
w AS (SELECT * FROM (SELECT kind, day, count(*) OVER past AS prior_times, {', '.join(f'sum({n}) OVER past / sum(contexts) OVER past AS {n}' for n, _ in products)} FROM t
  WINDOW past AS (PARTITION BY kind ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE prior_times >= {least})"""
    return sql + _solve_sql("w", "kind, day", names, SETS, alpha)


def _solve_sql(source: str, keys: str, names: list[str], sets: dict[str, list[str]], alpha: float) -> str:
    """CTEs up to set_c for each set: coefficients set_target_i of the sums in `source`."""
    sql = ""
    for s, columns in sets.items():
        use = [0, *(names.index(c) for c in columns)]
        d = len(use)
        at = lambda i, j: f"m{min(use[i], use[j])}_{max(use[i], use[j])}" + (f" + {alpha}" if i == j and i else "")  # noqa: E731, B023
        sql += f", {s}0 AS (SELECT {keys}, {', '.join([*(f'{at(i, j)} AS e{i}_{j}' for i in range(d) for j in range(d)), *(f'r{use[i]}_{t} AS r{i}_{t}' for i in range(d) for t in TARGETS)])} FROM {source})"
        for k in range(d - 1):
            less = lambda i, j: f"e{i}_{j} - e{i}_{k} * e{k}_{j} / e{k}_{k} AS e{i}_{j}" if i > k else f"e{i}_{j}"  # noqa: E731, B023
            right = lambda i, t: f"r{i}_{t} - e{i}_{k} * r{k}_{t} / e{k}_{k} AS r{i}_{t}" if i > k else f"r{i}_{t}"  # noqa: E731, B023
            sql += f", {s}{k + 1} AS (SELECT {keys}, {', '.join([*(less(i, j) for i in range(d) for j in range(d)), *(right(i, t) for i in range(d) for t in TARGETS)])} FROM {s}{k})"
        last = f"{s}{d - 1}"
        for i in reversed(range(d)):
            rest = lambda t: "".join(f" - e{i}_{j} * c{j}_{t}" for j in range(i + 1, d))  # noqa: E731, B023
            sql += f", {s}_b{i} AS (SELECT *, {', '.join(f'(r{i}_{t}{rest(t)}) / e{i}_{i} AS c{i}_{t}' for t in TARGETS)} FROM {last})"
            last = f"{s}_b{i}"
        sql += f", {s}_c AS (SELECT {keys}, {', '.join(f'c{i}_{t} AS {s}_{t}_{i}' for t in TARGETS for i in range(d))} FROM {last})"
    return sql


def _forward_sql(least: int, alpha: float) -> str:
    made = ", ".join(f"round({s}_{t}_0{''.join(f' + {s}_{t}_{i} * {c}' for i, c in enumerate(columns, 1))}, 5) AS {t}_{s}" for t in TARGETS for s, columns in SETS.items())
    joins = " ".join(f"JOIN {s}_c USING (kind, day)" for s in SETS)
    return _fits_sql(least, alpha) + f" SELECT kind, net, day, node, prior_times, {made} FROM x JOIN w USING (kind, day) {joins}"


@query(_forward_sql(2, 1.0))
def ml_forward_predictions(spark, sf_dir):
    """ML-16, ML-19, ML-20, ML-21: ridge on all strictly earlier days, contexts alike; three sets of features for two targets."""
    x = _days(spark, sf_dir)
    fits = forward.expanding_ridge(x, ["kind"], "day", ["net"], TARGETS, SETS, 1.0, 2)
    got = forward.predictions(x, fits, ["kind", "day"], TARGETS, SETS)
    return got.select("kind", "net", "day", "node", "prior_times", *(_r(f"{t}_{s}", f"{t}_{s}", 5) for t in TARGETS for s in SETS))


@query(_fits_sql(2, 1.0) + " SELECT kind, day, prior_times, round(hybrid_q_0, 5) AS intercept, " + ", ".join(f"round(hybrid_q_{i}, 5) AS {c}" for i, c in enumerate(SETS["hybrid"], 1)) + " FROM w JOIN hybrid_c USING (kind, day)")
def ml_forward_coefficients(spark, sf_dir):
    """ML-15, ML-19: coefficients at each anchor from running sums of products."""
    fits = forward.expanding_ridge(_days(spark, sf_dir), ["kind"], "day", ["net"], TARGETS, SETS, 1.0, 2)
    return fits.select("kind", "day", "prior_times", *(_r(F.get("q_hybrid", F.lit(i)), c, 5) for i, c in enumerate(["intercept", *SETS["hybrid"]])))


FAMILY_SETS = {"static": ["b"], "temporal": ["a", "b", "stable", "o"]}
HEURISTICS = {"activity": "a", "partners": "b", "composite": "(a + b + stable) / 3"}


def _family_sql(alpha: float) -> str:
    names = ["1", *dict.fromkeys(c for s in FAMILY_SETS.values() for c in s)]
    products = [(f"m{i}_{j}", f"{names[i]} * {names[j]}") for i in range(len(names)) for j in range(i, len(names))] + [(f"r{i}_{t}", f"{c} * {t}") for i, c in enumerate(names) for t in TARGETS]
    sql = DAYS + f""", c AS (SELECT kind, day, net, {', '.join(f'avg(({v})::DOUBLE) AS {n}' for n, v in products)} FROM x GROUP BY ALL), t AS (SELECT kind, {', '.join(f'avg({n}) AS {n}' for n, _ in products)} FROM c GROUP BY kind),
w AS (SELECT kind, (SELECT count(*) FROM t) - 1 AS training_families, {', '.join(f'(SELECT sum({n}) FROM t) - {n} AS {n}' for n, _ in products)} FROM t)""" + _solve_sql("w", "kind", names, FAMILY_SETS, alpha)
    made = ", ".join(f"round({s}_q_0{''.join(f' + {s}_q_{i} * {c}' for i, c in enumerate(columns, 1))}, 5) AS {s}" for s, columns in FAMILY_SETS.items())
    plain = ", ".join(f"round({v}, 6) AS {n}" for n, v in HEURISTICS.items())
    return sql + f" SELECT kind, net, day, node, training_families::INT AS training_families, {plain}, {made} FROM x JOIN w USING (kind) " + " ".join(f"JOIN {s}_c USING (kind)" for s in FAMILY_SETS)


@query(_family_sql(1.0))
def ml_family_scores(spark, sf_dir):
    """ML-15 to ML-18, ML-21: plain scores, and ridge scores from all other families by two sets of features, contexts and families alike."""
    x = _days(spark, sf_dir)
    fits = forward.family_ridge(x, "kind", ["net", "day"], TARGETS, FAMILY_SETS, 1.0)
    got = forward.predictions(x, fits, ["kind"], TARGETS, FAMILY_SETS)
    return got.select("kind", "net", "day", "node", "training_families", *(_r(F.expr(v), n) for n, v in HEURISTICS.items()), *(_r(f"q_{s}", s, 5) for s in FAMILY_SETS))


RATES = [round(0.05 * 1.25**k, 6) for k in range(20)]
DOSES = f"""+ e AS (
  SELECT event_id, kind, source_id % 25 AS family, (start - {ORIGIN}) // {WEEK} AS week, ("end" - start) / {float(HOUR)!r}::DOUBLE AS dose, (event_id % 4)::DOUBLE AS downstream, event_id * 7919 % 1000 / 1000.0::DOUBLE AS u FROM dyads),
doses AS (SELECT *, (u < 1 - exp(-0.6::DOUBLE * dose))::INT AS found, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - exp(-0.9::DOUBLE * dose) + (u - 0.5) / 10)) AS avoidable FROM e)"""


def _doses(spark, sf_dir):
    e = canonical.dyads(spark, sf_dir).select(
        "event_id", "kind", (F.col("source_id") % 25).alias("family"), F.floor((F.col("start") - ORIGIN) / WEEK).alias("week"), ((F.col("end") - F.col("start")) / float(HOUR)).alias("dose"),
        (F.col("event_id") % 4).cast("double").alias("downstream"), (F.col("event_id") * 7919 % 1000 / 1000.0).alias("u"))
    return e.withColumns({"found": (F.col("u") < curves.curve(F.col("dose"), 0.6)).cast("int"), "avoidable": F.least(F.lit(1.0), F.greatest(F.lit(0.0), curves.curve(F.col("dose"), 0.9) + (F.col("u") - 0.5) / 10))})


def _losses_sql(by: str) -> str:
    grid = f"(SELECT unnest(range({len(RATES)})) AS i, unnest([{', '.join(f'{r!r}::DOUBLE' for r in RATES)}]) AS rate)"
    p = "least(greatest(1 - exp(-rate * dose), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)"
    return f""", l AS (
  SELECT {by}, i, rate, count(*) AS n, avg(-(found * ln({p}) + (1 - found) * ln(1 - {p}))) AS found_loss,
         CASE WHEN sum(downstream) > 0 THEN sum(downstream * abs(1 - exp(-rate * dose) - avoidable)) / sum(downstream) ELSE avg(abs(1 - exp(-rate * dose) - avoidable)) END AS burden_loss
  FROM doses, {grid} GROUP BY ALL)"""


_ARG = "arg_min(rate, round({c}, 12) * 1e6 + i * 1e-9) AS {n}"


@query(DOSES + _losses_sql("kind, family") + """, t AS (SELECT kind, i, sum(found_loss) AS fl, sum(burden_loss) AS bl, count(*) AS f, sum(n) AS n FROM l GROUP BY ALL),
h AS (SELECT l.kind, l.family, l.i, l.rate, f - 1 AS training_families, t.n - l.n AS training_rows, round((fl - found_loss) / (f - 1), 12) AS a, round((bl - burden_loss) / (f - 1), 12) AS b FROM l JOIN t ON l.kind = t.kind AND l.i = t.i WHERE f > 1),
a AS (SELECT DISTINCT ON (kind, family) kind, family, rate FROM h ORDER BY kind, family, a, i), b AS (SELECT DISTINCT ON (kind, family) kind, family, rate FROM h ORDER BY kind, family, b, i)
SELECT DISTINCT h.kind, h.family, h.training_families, h.training_rows::BIGINT AS training_rows, a.rate AS found_rate, b.rate AS burden_rate FROM h JOIN a USING (kind, family) JOIN b USING (kind, family)""")
def ml_grid_without_family(spark, sf_dir):
    """ML-25, ML-26: saturation rates from all other families, by log loss and by weighted absolute error."""
    d = _doses(spark, sf_dir)
    key = ["kind", "family", "training_families", "training_rows"]
    a = curves.fit_without_each(d, ["kind"], "family", "dose", "found", RATES, "log_loss").withColumnRenamed("rate", "found_rate")
    b = curves.fit_without_each(d, ["kind"], "family", "dose", "avoidable", RATES, "absolute_error", "downstream").withColumnRenamed("rate", "burden_rate")
    return a.join(b, key).select(*key, "found_rate", "burden_rate")


@query(DOSES + _losses_sql("kind, family, week") + """, h AS (SELECT * FROM (SELECT kind, family, week, i, rate, round(avg(found_loss) OVER p, 12) AS a, round(avg(burden_loss) OVER p, 12) AS b, count(*) OVER p AS prior_times, sum(n) OVER p AS training_rows FROM l
  WINDOW p AS (PARTITION BY kind, family, i ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE prior_times >= 2),
a AS (SELECT DISTINCT ON (kind, family, week) kind, family, week, rate FROM h ORDER BY kind, family, week, a, i), b AS (SELECT DISTINCT ON (kind, family, week) kind, family, week, rate FROM h ORDER BY kind, family, week, b, i),
m AS (SELECT DISTINCT kind, family, week, prior_times, training_rows FROM h)
SELECT d.kind, d.family, d.week, m.prior_times, m.training_rows::BIGINT AS training_rows, a.rate AS found_rate, b.rate AS burden_rate, count(*) AS n, round(avg(1 - exp(-a.rate * dose)), 9) AS predicted, round(avg(found), 9) AS observed,
       round(avg(abs(1 - exp(-b.rate * dose) - avoidable)), 9) AS burden_error
FROM doses d JOIN m USING (kind, family, week) JOIN a USING (kind, family, week) JOIN b USING (kind, family, week) GROUP BY ALL""")
def ml_grid_rolling(spark, sf_dir):
    """ML-25, ML-27: rates from strictly earlier weeks of the same family, and how they do in the week."""
    d = _doses(spark, sf_dir)
    key = ["kind", "family", "week"]
    a = curves.fit_before_each(d, ["kind", "family"], "week", "dose", "found", RATES, "log_loss", 2).withColumnRenamed("rate", "found_rate").drop("latest")
    b = curves.fit_before_each(d, ["kind", "family"], "week", "dose", "avoidable", RATES, "absolute_error", 2, "downstream").select(*key, F.col("rate").alias("burden_rate"))
    x = d.join(a.join(b, key), key)
    return x.groupBy(*key, "prior_times", "training_rows", "found_rate", "burden_rate").agg(
        F.count("*").alias("n"), _r(F.avg(curves.curve(F.col("dose"), F.col("found_rate"))), "predicted", 9), _r(F.avg("found"), "observed", 9),
        _r(F.avg(F.abs(curves.curve(F.col("dose"), F.col("burden_rate")) - F.col("avoidable"))), "burden_error", 9))


SIGNED = f"""+ v AS (SELECT kind, source_id % 6 AS family, source_id AS unit, (start - {ORIGIN}) // {WEEK} AS week, event_id % 4 AS replicate, CASE WHEN event_id % 2 = 0 THEN weight ELSE -weight END AS v FROM dyads)"""


def _signed(spark, sf_dir):
    return canonical.dyads(spark, sf_dir).select(
        "kind", (F.col("source_id") % 6).alias("family"), F.col("source_id").alias("unit"), F.floor((F.col("start") - ORIGIN) / WEEK).alias("week"), (F.col("event_id") % 4).alias("replicate"),
        F.when(F.col("event_id") % 2 == 0, F.col("weight")).otherwise(-F.col("weight")).alias("v"))


def bootstrap_ctes(source: str, by: list[str], levels: list[str], replicates: int, seed: int, one_of_last: bool = False) -> str:
    """CTEs up to boot: what `resampling.multilevel_bootstrap` gives for the column v of a table."""
    keys = ", ".join(by)
    group = f"concat_ws(chr(30), {', '.join(f'{c}::VARCHAR' for c in by)})"
    sql = f", rws AS (SELECT {keys}, {', '.join(levels)}, avg(v) AS v FROM {source} WHERE v IS NOT NULL GROUP BY ALL), d0 AS (SELECT {keys}, unnest(range({replicates})) AS r, 1::BIGINT AS hits, 1.0::DOUBLE AS w FROM (SELECT DISTINCT {keys} FROM rws))"
    same = lambda a, b, cols: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)
    of = lambda a, cols: ", ".join(f"{a}.{c}" for c in cols)
    for k, name in enumerate(levels):
        above = levels[:k]
        cols = [*by, *above]
        key = ", ".join(cols)
        one = one_of_last and k == len(levels) - 1
        parent = f"concat_ws(chr(30), {', '.join(f'{c}::VARCHAR' for c in above)})" if above else "''"
        sql += f""", n{k} AS (SELECT {key}, {name}, row_number() OVER (PARTITION BY {key} ORDER BY {name}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS size FROM (SELECT DISTINCT {key}, {name} FROM rws)),
q{k} AS (SELECT {of('d', cols)}, r, w{'' if one else ' / size'} AS w, size, unnest(range(hits{'' if one else ' * size'})) AS q FROM d{k} d JOIN (SELECT DISTINCT {key}, size FROM n{k}) n ON {same('d', 'n', cols)}),
u{k} AS (SELECT {key}, r, w, floor((('0x' || substr(sha256('{seed}' || chr(31) || {group} || chr(31) || r || chr(31) || '{k}' || chr(31) || {parent} || chr(31) || q), 1, 16))::UBIGINT::DOUBLE + 0.5) / 18446744073709551616.0::DOUBLE * size)::BIGINT AS i FROM q{k}),
d{k + 1} AS (SELECT {of('u', cols)}, {name}, r, count(*) AS hits, w FROM u{k} u JOIN n{k} n ON {same('u', 'n', [*cols, 'i'])} GROUP BY ALL)"""
    whole = [*by, *levels]
    sql += f", e AS (SELECT {of('d', by)}, r, sum(hits * w * v) AS m FROM d{len(levels)} d JOIN rws x ON {same('d', 'x', whole)} GROUP BY ALL), q AS (SELECT {keys}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m > 0)::INT) AS p_positive FROM e GROUP BY {keys})"
    last = "rws"
    for k in range(len(levels), 0, -1):
        sql += f", a{k} AS (SELECT {keys}, {', '.join(levels[:k])}, avg(v) AS v FROM {last} GROUP BY ALL)"
        last = f"a{k}"
    counted = ", ".join([*by, *(levels[:-1] if one_of_last else levels)])
    return sql + f""", g AS (SELECT {keys}, count(*) AS families, avg(v) AS mean, avg((v > 0)::INT) AS positive_share FROM a1 GROUP BY {keys}), c AS (SELECT {keys}, count(*) AS contexts FROM (SELECT DISTINCT {counted} FROM rws) GROUP BY {keys}),
boot AS (SELECT {of('g', by)}, families, contexts, mean, low, high, positive_share, p_positive FROM g JOIN c ON {same('g', 'c', by)} JOIN q ON {same('g', 'q', by)})"""


def _bootstrap_sql(levels: list[str], replicates: int, seed: int, one_of_last: bool = False) -> str:
    return SIGNED + bootstrap_ctes("v", ["kind"], levels, replicates, seed, one_of_last) + " SELECT kind, families, contexts, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(positive_share, 6) AS positive_share, round(p_positive, 6) AS p_positive FROM boot"


def _bootstrapped(x):
    return x.select("kind", "families", "contexts", *(_r(c, c) for c in ("mean", "low", "high", "positive_share", "p_positive")))


@query(_bootstrap_sql(["family", "unit"], 40, 11))
def ml_bootstrap_units(spark, sf_dir):
    """ML-03, ML-07, ML-08: families and their units."""
    return _bootstrapped(resampling.multilevel_bootstrap(_signed(spark, sf_dir), ["kind"], ["family", "unit"], "v", 40, 11))


@query(_bootstrap_sql(["family", "unit", "week"], 40, 12))
def ml_bootstrap_contexts(spark, sf_dir):
    """ML-02, ML-04, ML-05: families, units and contexts."""
    return _bootstrapped(resampling.multilevel_bootstrap(_signed(spark, sf_dir), ["kind"], ["family", "unit", "week"], "v", 40, 12))


@query(_bootstrap_sql(["family", "unit", "week", "replicate"], 40, 13, True))
def ml_bootstrap_shuffles(spark, sf_dir):
    """ML-06: families, units, contexts, and one replicate of each drawn context."""
    return _bootstrapped(resampling.multilevel_bootstrap(_signed(spark, sf_dir), ["kind"], ["family", "unit", "week", "replicate"], "v", 40, 13, one_of_last=True))
