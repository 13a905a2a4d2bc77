"""Small cases of decision gates and evaluation windows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.operators import gates, resampling, windows

RULES = [("both", ["a", "b"]), ("one", ["a"])]


def effects(spark):
    rows = []
    for f in range(5):
        for u in range(4):
            rows += [("m", "a", f, u, 2.0 + u / 10), ("m", "b", f, u, 1.0 if f else -9.0), ("n", "a", f, u, 1.0 if f > 2 else -1.0), ("n", "b", f, u, 3.0)]
    rows += [("m", "a", None, 1, -99.0), ("m", "b", 0, 1, None)]
    return spark.createDataFrame(rows, "model string, contrast string, family long, unit long, v double")


def test_levels_need_the_interval_and_the_families(spark):
    got = {(r["model"], r["contrast"]): r for r in gates.gates(effects(spark), ["model"], "contrast", "family", "unit", "v", 60, 3).collect()}
    assert {k: r["level"] for k, r in got.items()} == {("m", "a"): "strong", ("m", "b"): "unsupported", ("n", "a"): "unsupported", ("n", "b"): "strong"}
    assert (got["m", "b"]["families"], got["m", "b"]["required"], got["m", "b"]["positive"]) == (5, 4, 4) and got["m", "b"]["mean"] == pytest.approx(-1.0)
    d = {r["model"]: r["decision"] for r in gates.decide(gates.gates(effects(spark), ["model"], "contrast", "family", "unit", "v", 60, 3), ["model"], "contrast", RULES, "none").collect()}
    assert d == {"m": "one", "n": "none"}


def test_decisions_without_each_family_and_what_they_say(spark):
    found = gates.gates(gates.without_each(effects(spark), "family"), ["held_out", "model"], "contrast", "family", "unit", "v", 60, 3)
    d = gates.decide(found, ["held_out", "model"], "contrast", RULES, "none")
    got = {(r["held_out"], r["model"]): r["decision"] for r in d.collect()}
    assert set(got) == {(h, m) for h in (None, 0, 1, 2, 3, 4) for m in "mn"}
    assert got[0, "m"] == "both" and got[1, "m"] == "one" and got[None, "m"] == "one"  # without family 0 both contrasts pass
    r = {x["model"]: (x["folds"], x["same"], x["status"]) for x in gates.resilience(d, ["model"], "held_out").collect()}
    assert r == {"m": (5, 4, "mixed"), "n": (5, 5, "robust")}
    e = {x["model"]: x["evidence"] for x in gates.evidence_classes(gates.resilience(d, ["model"], "held_out"), gates.resilience(d, ["model"], "held_out"), ["model"], "none", "one").collect()}
    assert e == {"m": "pooled_history_only", "n": "abstain"}
    j = {x["held_out"]: x["level"] for x in gates.joint(found, ["held_out"], "model", "contrast", ["a", "b"]).collect()}
    assert j[None] == "unsupported" and gates.joint(found.where("contrast = 'b'"), ["held_out"], "model", "contrast", ["a", "b"]).where("held_out is null").first()["level"] == "incomplete"


def test_a_group_may_have_a_null_key(spark):
    df = spark.createDataFrame([(None, 1, 1, 2.0), ("x", 1, 1, 3.0)], "g string, f long, u long, v double")
    assert {r["g"]: r["mean"] for r in resampling.multilevel_bootstrap(df, ["g"], ["f", "u"], "v", 5, 1).collect()} == {None: 2.0, "x": 3.0}
    assert resampling.multilevel_bootstrap(df, [], ["g", "u"], "v", 5, 1).first()["families"] == 1


def test_both_sides_of_a_setting(spark):
    kinds = "e string, d string, mean double, low double, high double"
    rows = [("relative", "x", 1.0, 0.5, 2.0), ("absolute", "x", 2.0, 1.0, 3.0), ("relative", None, 1.0, -0.5, 2.0), ("absolute", None, 2.0, 1.0, 3.0), ("relative", "y", -1.0, -2.0, -0.5), ("absolute", "y", 0.0, -1.0, 1.0), ("relative", "z", 1.0, 0.5, 2.0)]
    got = {r["d"]: (r["relative_status"], r["absolute_status"], r["decision"].split("_")[0]) for r in gates.frontier(spark.createDataFrame(rows, kinds), "e", ["d"]).collect()}
    assert got == {"x": ("supported_positive", "supported_positive", "direct"), None: ("uncertain_positive", "supported_positive", "additional"), "y": ("supported_negative", "zero", "abstain")}
    with pytest.raises(PySparkException, match="several relative rows"):
        gates.frontier(spark.createDataFrame([*rows, rows[0]], kinds), "e", ["d"]).collect()


def test_windows_need_support_before_and_after(spark):
    events = [("u", k, k, k + 1) for k in range(12)] + [("u", 50, 30, 31), ("u", 51, None, 4), ("v", 60, 0, 1)]
    members = [(k, n) for k in range(12) for n in (("a", "b") if k % 2 else ("a", "c"))] + [(50, "x"), (50, "y"), (60, "a"), (60, "b"), (3, "b")]
    e, m = spark.createDataFrame(events, "unit string, event long, start long, end long"), spark.createDataFrame(members, "event long, node string")
    a = spark.createDataFrame([("u", 0, 4, 8), ("u", 4, 8, 12), ("u", 8, 12, 16), ("v", 0, 4, 8)], "unit string, history_start long, anchor long, horizon_end long")
    w, nodes = windows.supported_windows(e, m, a, 2, 3)
    assert sorted((r["unit"], r["anchor"], r["number"], r["eligible"], r["active"], r["future_events"]) for r in w.collect()) == [("u", 4, 1, 3, 3, 4), ("u", 8, 2, 3, 3, 4)]
    assert {(r["anchor"], r["node"]): r["support"] for r in nodes.collect()} == {(4, "a"): 4, (4, "b"): 2, (4, "c"): 2, (8, "a"): 4, (8, "b"): 2, (8, "c"): 2}
    assert windows.supported_windows(e, m, a, 5, 3)[0].collect() == []


def test_anchors_at_observed_blocks(spark):
    e = spark.createDataFrame([("u", t, t + 1) for t in (0, 1, 10, 30, 31, 50, 70)] + [("u", 90, 90), ("v", 0, 5)], "unit string, start long, end long")
    got = windows.block_anchors(e, F.floor(F.col("start") / 10) * 10, 10, 2)
    assert sorted((r["history_start"], r["anchor"], r["horizon_end"], r["index"]) for r in got.collect()) == [(0, 30, 40, 2), (10, 50, 60, 3), (30, 70, 80, 4)]
    assert [r["anchor"] for r in windows.block_anchors(e, F.floor(F.col("start") / 10) * 10, 10, 2, [3]).collect()] == [50]
