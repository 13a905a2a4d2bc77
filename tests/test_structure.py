"""Small cases of factorial parts, retention, range joins, subsets, rings and chosen sets."""

import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.operators import intervals, policies, structure



def factors():
    return {n: F.col(n) for n in "abc"}


def test_factorial_parts_add_up_to_the_total(spark):
    rng = random.Random(2)
    rows = [("g", f, a, b, c, 3 * f + 2 * a - a * b + rng.random()) for f in range(5) for a in (False, True) for b in (False, True) for c in (False, True)]
    df = spark.createDataFrame(rows + [("u", *r[1:]) for r in rows[:-1]] + [("w", 0, *r[2:5], 1.0) for r in rows[:8]], "g string, f long, a boolean, b boolean, c boolean, y double")
    got = {(r["g"], r["component"]): r for r in structure.factorial_parts(df, ["g"], "f", factors(), "y").collect()}
    y = np.array([r[5] for r in rows])
    assert sum(got["g", k]["sum_squares"] for g, k in got if g == "g") == pytest.approx(((y - y.mean()) ** 2).sum())
    sign = np.array([(1 if r[2] else -1) * (1 if r[3] else -1) for r in rows])
    assert got["g", "a x b"]["sum_squares"] == pytest.approx((y @ sign) ** 2 / len(y)) and sum(got["g", k]["share"] for g, k in got if g == "g") == pytest.approx(1)
    assert len(got) == 27 and not any(got["u", k]["balanced"] or got["u", k]["sum_squares"] is not None for g, k in got if g == "u")
    assert all(got["w", k]["sum_squares"] == 0 and got["w", k]["share"] == 0 for g, k in got if g == "w")  # all equal


def test_a_repeated_cell_is_not_balanced(spark):
    rows = [(0, a, b, True, 1.0) for a in (False, True) for b in (False, True)] * 2
    df = spark.createDataFrame(rows, "f long, a boolean, b boolean, c boolean, y double")
    assert not structure.factorial_parts(df, [], "f", factors(), "y").first()["balanced"]


def test_retention_beyond_chance(spark):
    edge = "g string, a long, b long, w double"
    nodes = spark.createDataFrame([(g, n) for g in "xyz" for n in range(4)], "g string, node long")
    every = [("y", a, b, 1.0) for a, b in itertools.combinations(range(4), 2)]
    left = spark.createDataFrame([("x", 0, 1, 2.0), ("x", 1, 2, 1.0), *every], edge)
    right = spark.createDataFrame([("x", 0, 1, 4.0), ("x", 2, 3, 3.0), *every], edge)
    got = {r["g"]: r for r in structure.retention(left, right, nodes, ["g"], 0.25).collect()}
    x = got["x"]
    assert x["adjusted"] == pytest.approx((1 - 4 / 6) / (2 - 4 / 6)) and x["estimable"] and x["jaccard"] == pytest.approx(1 / 3)
    assert x["cosine"] == pytest.approx(8 / (5**0.5 * 5)) and x["top_overlap"] == 0.0 and x["n"] == 4
    assert (got["y"]["adjusted"], got["y"]["estimable"], got["y"]["cosine"], got["y"]["rank_persistence"]) == (0.0, False, pytest.approx(1.0), 0.0)  # saturated
    assert (got["z"]["jaccard"], got["z"]["cosine"], got["z"]["shared"], got["z"]["estimable"]) == (1.0, 0.0, 0, False)  # no edges


def test_range_join_equals_brute_force(spark):
    rng = random.Random(8)
    span = lambda: (s := rng.randrange(-50, 200), s + rng.choice([0, 1, 7, 40, 130]))
    left = [(k, rng.choice("ab"), *span()) for k in range(60)] + [(97, "a", None, 5), (98, "a", 9, 4), (99, None, 0, 9)]
    right = [(k, rng.choice("ab"), *span()) for k in range(50)]
    a = spark.createDataFrame(left, "i long, k string, s long, e long")
    b = spark.createDataFrame(right, "j long, k string, c long, d long")
    want = sorted((i, j) for i, k, s, e in left for j, m, c, d in right if k == m and None not in (s, e) and s < e and c < d and s < d and c < e)
    for width in (1, 16, 1000):
        got = intervals.range_join(a, b, ["k"], ("s", "e"), ("c", "d"), width)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_support_in_a_history(spark):
    spans = spark.createDataFrame([("a", 0, 4), ("a", 2, 6), ("a", 8, 20), ("b", 30, 40)], "k string, s long, e long")
    windows = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "k string, low long, high long")
    got = {r["k"]: r for r in intervals.coverage_of(spans, windows, ["k"], ("s", "e"), ("low", "high"), 5).collect()}
    assert (got["a"]["first"], got["a"]["last"], got["a"]["covered"]) == (1, 10, 7) and (got["b"]["first"], got["b"]["covered"]) == (None, 0)


def test_subsets_of_small_pools_and_an_error_beyond(spark):
    df = spark.createDataFrame([("p", x) for x in "cab"] + [("p", None), ("p", "a"), ("q", "z")], "g string, x string")
    got = structure.subsets(df, ["g"], "x", 2)
    assert sorted(tuple(r["items"]) for r in got.where("g = 'p'").collect()) == sorted([(), ("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")])
    assert {(r["mask"], r["bigger"]) for r in structure.extensions(got, ["g"]).where("g = 'q'").collect()} == {(0, 1)}
    with pytest.raises(PySparkException, match="more than 2"):
        structure.subsets(df, ["g"], "x", 2, most=2).collect()


def test_violations_need_both_halves(spark):
    sets = structure.subsets(spark.createDataFrame([("p", x) for x in "abc"], "g string, x string"), ["g"], "x", 2).select("g", "mask", "size")
    worth = {0: 0.0, 1: 1.0, 2: 1.0, 4: 1.0, 3: 5.0, 5: 1.5, 6: 2.0}
    rows = [("p", b, m, v + (3.0 if m == 5 and b > 1 else 0.0)) for b in range(4) for m, v in worth.items()]
    got = structure.violations(spark.createDataFrame(rows, "g string, block long, mask long, value double"), sets, ["g"]).first()
    assert (got["inequalities"], got["replicated"]) == (6, 2)  # a beside b and b beside a; {a, c} gains in the later half only
    assert got["mean_margin"] == pytest.approx(1 - 4) and got["rate"] == pytest.approx(1 / 3)
    small = structure.violations(spark.createDataFrame([], "g string, block long, mask long, value double"), sets.where("size < 2"), ["g"]).first()
    assert small["inequalities"] == 0 and small["rate"] is None


def test_rings_of_all_cases(spark):
    rng = random.Random(1)
    contacts = [("k", a, b, float(rng.randrange(0, 4)), 1.0) for a in range(12) for b in range(12) if a != b and rng.random() < 0.3]
    c = spark.createDataFrame(contacts, "g string, node long, partner long, w double, v double")
    e = spark.createDataFrame([("k", n, float(n // 3)) for n in range(11)], "g string, node long, stable double")
    cases = spark.createDataFrame([("k", 0), ("k", 5), ("k", 77)], "g string, case long")
    got = structure.case_rings(c, e, cases, ["g"], {"m": "w"}, 4, 9)
    order = {r["node"]: r["h"] for r in spark.range(12).select(F.col("id").alias("node"), policies.hash_order(F.col("id"), 9, "m", "ties").alias("h")).collect()}
    for case in (0, 5, 77):
        near = {b: w for _, a, b, w, _ in contacts if a == case}
        want = sorted((n for n in range(11) if n != case), key=lambda n: (-near.get(n, 0.0), -(n // 3), order[n], n))[:4]
        assert [r["node"] for r in got.where(F.col("case") == case).orderBy("position").collect()] == want


def test_greedy_sets_of_all_contexts(spark):
    rng = random.Random(3)
    weights = [(g, a, b, float(rng.randrange(1, 9))) for g in "xy" for a, b in itertools.permutations(range(7), 2) if rng.random() < 0.5]
    got = policies.greedy_sets(spark.createDataFrame(weights, "g string, node long, partner long, w double"), ["g"], 3, 4)
    order = {r["node"]: r["h"] for r in spark.range(7).select(F.col("id").alias("node"), policies.hash_order(F.col("id"), 4, "history_coverage_ties").alias("h")).collect()}
    for g in "xy":
        chosen = []
        for _ in range(3):
            cover = {}
            for h, a, b, w in weights:
                if h == g and a in chosen:
                    cover[b] = max(cover.get(b, 0.0), w)
            gain = {}
            for h, a, b, w in weights:
                if h == g and a not in chosen:
                    gain[a] = gain.get(a, 0.0) + (0.0 if b in chosen else max(0.0, w - cover.get(b, 0.0)))
            chosen.append(min(gain, key=lambda n: (-gain[n], order[n], n)))
        assert [r["node"] for r in got.where(F.col("g") == g).orderBy("position").collect()] == chosen
