"""Small cases of fits that look back, curves on a grid and nested bootstraps."""

import math
import random

import numpy as np
import pytest

from tidewater.operators import curves, forward, resampling


def test_expanding_ridge_equals_a_direct_fit(spark):
    rng = random.Random(3)
    rows = [("s", t, c, rng.random(), rng.random()) for t in (1, 2, 4, 7) for c in range(1 + t % 2) for _ in range(3 + c)]
    rows = [(*r, 2 + r[3] - 3 * r[4] + rng.random() / 9) for r in rows] + [("s", 2, 0, None, 1.0, 1.0), ("u", 1, 0, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "s string, t long, c int, a double, b double, y double")
    sets = {"one": ["a"], "two": ["a", "b"]}
    fits = forward.expanding_ridge(df, ["s"], "t", ["c"], ["y"], sets, 0.7, 2)
    got = {r["t"]: r for r in fits.collect()}
    assert set(got) == {4, 7} and got[4]["prior_times"] == 2 and got[7]["prior_times"] == 3  # time 2 has one earlier one, series u none
    for t, r in got.items():
        past = [x for x in rows if x[0] == "s" and x[1] < t and x[3] is not None]
        contexts = {(x[1], x[2]) for x in past}
        w = np.array([1 / sum((y[1], y[2]) == (x[1], x[2]) for y in past) / len(contexts) for x in past])
        for name, columns in sets.items():
            m = np.array([[1.0, *(x[3 + "ab".index(c)] for c in columns)] for x in past])
            want = np.linalg.solve(m.T @ (m * w[:, None]) + np.diag([0.0] + [0.7] * len(columns)), m.T @ (w * np.array([x[5] for x in past])))
            assert r[f"y_{name}"] == pytest.approx(want.tolist())
    p = forward.predictions(df, fits, ["s", "t"], ["y"], sets).where("t = 7").first()
    assert p["y_two"] == pytest.approx(got[7]["y_two"][0] + got[7]["y_two"][1] * p["a"] + got[7]["y_two"][2] * p["b"])
    with pytest.raises(ValueError):
        forward.expanding_ridge(df, ["s"], "t", ["c"], ["y"], sets, 1.0, 0)


def test_a_singular_system_has_no_coefficients(spark):
    df = spark.createDataFrame([("s", t, 0, 1.0, float(t)) for t in (1, 2, 3)], "s string, t long, c int, a double, y double")
    got = forward.expanding_ridge(df, ["s"], "t", ["c"], ["y"], {"x": ["a"]}, 0.0, 1).collect()
    assert len(got) == 2 and all(r["y_x"] is None for r in got)
    assert forward.expanding_ridge(df.limit(0), ["s"], "t", ["c"], ["y"], {"x": ["a"]}, 0.0, 1).collect() == []


def test_fits_on_other_families_count_families_and_contexts_alike(spark):
    rng = random.Random(9)
    rows = [(f, c, rng.random() * 5, rng.random(), 7.0) for f in "xyz" for c in range(1 + "xyz".index(f)) for _ in range(2 + 3 * c)]
    rows = [(*r, 1 + 2 * r[2] - r[3] + rng.random()) for r in rows]
    df = spark.createDataFrame([*rows, ("x", 0, None, 1.0, 7.0, 1.0)], "f string, c int, a double, b double, k double, y double")
    sets = {"ab": ["a", "b"], "abk": ["a", "b", "k"]}
    for standardised in (False, True):
        got = {r["f"]: r for r in forward.family_ridge(df, "f", ["c"], ["y"], sets, 0.3, standardised).collect()}
        for held in "xyz":
            some = [r for r in rows if r[0] != held]
            w = np.array([1 / sum(o[:2] == r[:2] for o in rows) / len({o[1] for o in rows if o[0] == r[0]}) for r in some])
            for name, columns in sets.items():
                x = np.array([[r[2 + "abk".index(c)] for c in columns] for r in some])
                y = np.array([r[5] for r in some])
                mean, size = np.zeros(len(columns)), np.ones(len(columns))
                if standardised:
                    mean = np.average(x, axis=0, weights=w)
                    size = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
                    size = np.where(size > 1e-6, size, 1.0)
                m = np.column_stack([np.ones(len(x)), (x - mean) / size])
                c = np.linalg.solve(m.T @ (m * w[:, None]) + np.diag([0.0] + [0.3] * len(columns)), m.T @ (w * y))
                want = [c[0] - (c[1:] / size) @ mean, *(c[1:] / size)]
                assert got[held][f"y_{name}"] == pytest.approx(want, abs=1e-6) and got[held]["training_families"] == 2
    assert forward.family_ridge(df.where("f = 'x'"), "f", ["c"], ["y"], sets, 0.3).collect() == []


def losses(rows, rate, kind):
    out = []
    for dose, y, w in rows:
        p = 1 - math.exp(-rate * dose)
        q = min(max(p, 1e-12), 1 - 1e-12)
        out.append((abs(p - y) if kind == "absolute_error" else -(y * math.log(q) + (1 - y) * math.log(1 - q)), w))
    total = sum(w for _, w in out)
    return sum(v * w for v, w in out) / total if total > 0 else sum(v for v, _ in out) / len(out)


@pytest.mark.parametrize("kind", ["log_loss", "absolute_error"])
def test_grid_fits_without_a_family_and_before_a_time(spark, kind):
    rng = random.Random(5)
    rows = [(f, t, d := rng.random() * 4, float(rng.random() < 1 - math.exp(-0.7 * d)), float(rng.randrange(3)) if f != "z" else 0.0) for f in "xyz" for t in (1, 2, 3) for _ in range(8)]
    df = spark.createDataFrame([*rows, ("x", 1, None, 1.0, 1.0)], "f string, t long, d double, y double, w double")
    rates = [0.1, 0.3, 0.7, 1.5]
    got = {r["f"]: r for r in curves.fit_without_each(df, [], "f", "d", "y", rates, kind, "w").collect()}
    for held in "xyz":
        mean = [sum(losses([r[2:] for r in rows if r[0] == f], q, kind) for f in "xyz" if f != held) for q in rates]
        assert got[held]["rate"] == rates[int(np.argmin(mean))] and got[held]["training_families"] == 2 and got[held]["training_rows"] == 48
    got = {(r["f"], r["t"]): r for r in curves.fit_before_each(df, ["f"], "t", "d", "y", rates, kind, 2, "w").collect()}
    assert set(got) == {("x", 3), ("y", 3), ("z", 3)}
    for f in "xyz":
        mean = [sum(losses([r[2:] for r in rows if r[:2] == (f, t)], q, kind) for t in (1, 2)) for q in rates]
        assert got[f, 3]["rate"] == rates[int(np.argmin(mean))] and got[f, 3]["latest"] == 2
    assert curves.fit_without_each(df.where("f = 'x'"), [], "f", "d", "y", rates, kind).collect() == []
    with pytest.raises(ValueError):
        curves.fit_without_each(df, [], "f", "d", "y", rates, "squared")


def test_the_first_of_equal_rates_wins(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0)], "f string, d double, y double")
    assert {r["rate"] for r in curves.fit_without_each(df, [], "f", "d", "y", [0.5, 0.2], "absolute_error").collect()} == {0.5}


def test_bootstraps_have_the_right_spread_and_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = [("g", f, u, c, rng.gauss(f, 1 + u)) for f in range(4) for u in range(1 + f) for c in range(3)]
    df = spark.createDataFrame([*rows, ("g", 9, 0, 0, None), ("h", 0, 0, 0, 2.0)], "g string, f long, u long, c long, v double")
    got = {r["g"]: r for r in resampling.multilevel_bootstrap(df, ["g"], ["f", "u", "c"], "v", 400, 3).collect()}
    again = {r["g"]: r for r in resampling.multilevel_bootstrap(df.repartition(5), ["g"], ["f", "u", "c"], "v", 400, 3).collect()}
    assert got["h"]["low"] == got["h"]["high"] == got["h"]["mean"] == 2.0 and got["h"]["p_positive"] == 1.0
    assert again["g"]["low"] == pytest.approx(got["g"]["low"]) and again["g"]["high"] == pytest.approx(got["g"]["high"])
    tree = {}
    for _, f, u, _, v in rows:
        tree.setdefault(f, {}).setdefault(u, []).append(v)
    means = [np.mean([np.mean(c) for c in units.values()]) for units in tree.values()]
    assert got["g"]["mean"] == pytest.approx(np.mean(means)) and got["g"]["families"] == 4 and got["g"]["contexts"] == 30
    draw = np.random.default_rng(1)
    wanted = []
    for _ in range(4000):
        fs = []
        for f in draw.integers(0, 4, 4):
            units = list(tree[int(f)].values())
            fs.append(np.mean([np.mean(np.array(units[u])[draw.integers(0, 3, 3)]) for u in draw.integers(0, len(units), len(units))]))
        wanted.append(np.mean(fs))
    low, high = np.quantile(wanted, [0.025, 0.975])
    assert got["g"]["low"] == pytest.approx(low, abs=0.3) and got["g"]["high"] == pytest.approx(high, abs=0.3)


def test_a_shuffle_takes_one_of_its_replicates(spark):
    rows = [("g", 0, 0, 0, r, float(r % 2)) for r in range(10)]
    df = spark.createDataFrame(rows, "g string, f long, u long, c long, r long, v double")
    one = resampling.multilevel_bootstrap(df, ["g"], ["f", "u", "c", "r"], "v", 200, 3, one_of_last=True).first()
    assert (one["low"], one["high"], one["mean"], one["contexts"]) == (0.0, 1.0, 0.5, 1)  # a mean of ten would be near a half
    assert resampling.multilevel_bootstrap(df.limit(0), ["g"], ["f", "u"], "v", 10, 3).collect() == []
