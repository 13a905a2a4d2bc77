"""Every query with SQL against DuckDB on the smallest tables, and the operators' edge cases."""

import hashlib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import keyed, ranks
from tidewater.operators import exposure, intervals, policies, statistics
from tidewater.plans import catalogue, contract as contract_plans, evaluation, fits, gates, networks, structure, summaries, temporal, text  # noqa: F401
from tidewater.sources import contract

SF = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders")
#: Many turns or the same work thrice; their operators are tested against simulations.
LONG = {"gr_temporal_audit", "gr_time_rules"}


def canon(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("the generated tables aren't here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - LONG))
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(tuple(r[c] for c in names) for r in df.collect()) == canon(found.fetchall())


def test_touching_intervals_merge_and_null_keys_are_a_group(spark):
    rows = [("a", 0, 10), ("a", 10, 12), ("a", 14, 20), ("a", 1, 2), (None, 0, 1), (None, 1, 3)]
    got = intervals.islands(spark.createDataFrame(rows, "k string, start long, end long"), ["k"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 0, 12, 3), ("a", 14, 20, 1), (None, 0, 3, 2)]))
    wide = intervals.islands(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], 2).where("k = 'a'").collect()
    assert [tuple(r) for r in wide] == [("a", 0, 20, 4)]


def test_segments_keep_the_whole_length(spark):
    df = spark.createDataFrame([(1, 5, 27), (2, 10, 20), (3, 7, 7)], "id long, start long, end long")
    got = intervals.segments(df, 10).orderBy("id", "part").select("id", "part", "start", "end").collect()
    assert [tuple(r) for r in got] == [(1, 0, 5, 10), (1, 1, 10, 20), (1, 2, 20, 27), (2, 0, 10, 20)]


def test_sliding_windows_are_those_that_an_interval_meets(spark):
    df = spark.createDataFrame([(12, 18)], "start long, end long")
    got = {r["window"]: (r["start"], r["end"]) for r in intervals.windows(df, 0, 10, 5).collect()}
    assert got == {1: (12, 15), 2: (12, 18), 3: (15, 18)}


def test_average_ranks_and_constant_sides(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    got = {(r.g, r.y): r.p for r in ranks.average_rank(df, "x", ["g"], "p", True).collect()}
    assert got[("a", 1.0)] == got[("a", 2.0)] == 0.5 and got[("a", 3.0)] == 1.0 and got[("a", 9.0)] is None
    rho = {r.g: r.spearman for r in ranks.spearman(df, "x", "y", ["g"]).collect()}
    assert rho["a"] == pytest.approx(0.8660254037844387) and rho["b"] is None


def test_keyed_numbers_depend_on_the_key_alone(spark):
    df = spark.range(50).repartition(7)
    got = {r.id: r.u for r in df.select("id", keyed.uniform(3, "x", F.col("id")).alias("u")).collect()}
    for i in range(50):
        h = hashlib.sha256(f"3\x1fx\x1f{i}".encode()).digest()
        assert got[i] == (int.from_bytes(h[:8], "big") + 0.5) / 2**64


def test_large_groups_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(exposure, "BLOCK", 3)
    df = spark.createDataFrame([("g", n) for n in range(11)], "group_id string, node_id long")
    got = [(r.a, r.b) for r in exposure.group_pairs(df, 10.0).collect()]
    assert sorted(got) == [(a, b) for a in range(11) for b in range(a + 1, 11)]


def test_group_of_three_gives_half_a_share_to_each_pair(spark):
    df = spark.createDataFrame([("g", n) for n in "abc"] + [("h", "a")], "group_id string, node_id string")
    got = {(r.a, r.b): r.contact_seconds for r in exposure.group_pairs(df, 10.0).collect()}
    assert got == {("a", "b"): 5.0, ("a", "c"): 5.0, ("b", "c"): 5.0}


def test_five_positives_of_five(spark):
    got = spark.range(1).select(statistics.binomial_tail(F.lit(5), F.lit(5)).alias("p")).first().p
    assert got == pytest.approx(1 / 32)
    many = spark.range(1).select(statistics.binomial_tail(F.lit(60), F.lit(100)).alias("p")).first().p
    assert many == pytest.approx(sum(math.comb(100, i) for i in range(60, 101)) / 2**100)


def test_fixed_cases_of_evaluation(spark):
    """Known small inputs: constant scores, twins, a shift of the best, coverage, strictly prior history."""
    scored = spark.createDataFrame([("x", n, float(v), 1.0) for n, v in zip("abcd", range(4), strict=True)], "c string, node string, v double, constant double")
    got = {r.method: r for r in policies.evaluate_scores(scored, ["c"], "v", ["constant", "random"], 0.5).collect()}
    assert got["constant"].spearman == 0 and got["constant"].selected_value == 1.5 and got["random"].selected_value == 1.5
    assert got["random"].capture == 0 and got["random"].overlap == 0.5
    same = [("a", n, v) for n, v in zip("wxyz", (4.0, 3.0, 2.0, 1.0), strict=True)] + [("b", n, v) for n, v in zip("wxyz", (8.0, 6.0, 1.0, 0.0), strict=True)]
    r = policies.rank_stability(spark.createDataFrame(same, "c string, node string, v double"), "c", "node", "v", 2).first()
    assert (round(r.spearman, 9), r.overlap_fraction, r.jaccard, r.retention, r.regret) == (1, 1, 1, 1, 0)
    moved = [("a", n, v) for n, v in zip("xyz", (3.0, 2.0, 1.0), strict=True)] + [("b", n, v) for n, v in zip("xyz", (1.0, 3.0, 2.0), strict=True)]
    r = policies.rank_stability(spark.createDataFrame(moved, "c string, node string, v double"), "c", "node", "v", 1).first()
    assert r.overlap == 0 and r.regret == 1.5 and r.retention == pytest.approx((1 / 3 + 2 / 3) / 2)
    pairs = [(1, 2, 10.0), (1, 3, 9.0), (4, 5, 8.0)]
    w = spark.createDataFrame([x for a, b, v in pairs for x in ((a, b, v), (b, a, v))], "node long, partner long, w double")
    chosen = [r.node for r in policies.greedy_coverage(w, 2, 1).orderBy("position").collect()]
    assert chosen[0] == 1 and chosen[1] in (4, 5)
    h = spark.createDataFrame([("d", "a", 1, 0.2, 5.0), ("d", "a", 2, 0.4, 7.0), ("d", "a", 3, 0.9, 1.0), ("d", "b", 3, 0.1, 2.0)], "d string, node string, t long, s double, v double")
    last = {(r.node, r.t): r for r in policies.prior_history(h, ["d"], "node", "t", "s", "v").collect()}
    assert last["a", 3].stable == pytest.approx(0.3) and last["a", 3].last == 0.4 and last["a", 3].observations == 2
    assert last["a", 1].stable == 0.5 and last["a", 1].raw == 0 and last["b", 3].stable == 0.5 and last["b", 3].raw == 6
    cells = spark.createDataFrame([(r, c, float(v)) for r, v in (("a", 1), ("b", 5)) for c in (1, 2)], "r string, c int, v double")
    v = statistics.two_way(cells, "r", "c", "v").first()
    assert (v.status, v.row_fraction, v.col_fraction, v.residual_fraction) == ("estimated", 1, 0, 0)
    assert spark.range(1).select(statistics.spearman_brown(F.lit(-0.5), 3).alias("x")).first().x == 0


def test_contract_of_streams_and_bundles(spark, tmp_path):
    rows = [("duration", "A", "B", 0, 10, None), ("flagged", "A", "B", 0, 10, "exact_duplicate_source_record"), ("empty", "A", "B", 5, 5, None), ("loop", "A", "A", 0, 3, None)]
    d = spark.createDataFrame(rows, "event_id string, source_id string, target_id string, start long, end long, quality_flag string")
    assert [r.event_id for r in contract.exposures(d, "duration", F.lit(1.0)).collect()] == ["duration"]
    names = spark.createDataFrame([(" 12.0 ",), (None,), ("x.05",)], "v string").select(contract.node_id(F.col("v")).alias("n"))
    assert [r.n for r in names.collect()] == ["12", "", "x.05"]
    a, b = contract.canonical_pair(F.lit("b"), F.lit("a"))
    assert tuple(spark.range(1).select(a, b).first()) == ("a", "b")
    tables = {"memberships": spark.createDataFrame([("g", 1)], "group_id string, node_id long"), "dyads": contract.empty(spark, "dyads")}
    contract.write_bundle(tables, str(tmp_path))
    back = contract.read_bundle(spark, str(tmp_path), list(tables))
    assert back["memberships"].collect() == [("g", 1, None)] and back["dyads"].count() == 0
    cut = intervals.cut_at(spark.createDataFrame([("e", "a", "b", 0, 30, 2.0)], "id string, source_id string, target_id string, start long, end long, multiplier double"), [10, 20, 99])
    phases = spark.createDataFrame([("p", 10, 20, 0.25), ("q", 20, 30, 0.25)], "phase string, start long, end long, residual double")
    at = spark.createDataFrame([("p", "a"), ("q", "a"), ("q", "b")], "phase string, node string")
    assert [(r.part, r.multiplier) for r in intervals.reduced(cut, phases, at).orderBy("part").collect()] == [(0, 2.0), (1, 0.5), (2, 0.125)]


def test_entry_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).parents[1]
    shutil.copytree(top / "tidewater", tmp_path / "tidewater", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'coattendance_pairs' in q and not [k for k in q if k.startswith('op') or k == 'pipeline'], q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
