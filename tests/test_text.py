"""Delimited files by a declared layout, and runs of one state."""

from pyspark.sql import functions as F

from tidewater.operators import intervals
from tidewater.sources import text

LAYOUT = text.Layout("a string, b string, t string, s double", {"event_id": "concat(a, b)", "source_id": "a", "target_id": "b", "start": "try_cast(t as long)", "end": "try_cast(t as long) + cast(s as long)"}, ("source_id", "start"), separator="|")


def test_pairs_of_a_file(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a|b|t|s\n7.0|3|5|2\n3|7|x|1\n|4|9|1\n1|2|6|many\n1|2|6\nz|a|8|1|extra\n\n9|9|1|0\n")
    ds, rejects = text.pair_dataset(spark, "f", str(tmp_path), LAYOUT)
    got = sorted((r["source_id"], r["target_id"], r["start"], r["end"], r["directed"], r["dataset_id"]) for r in ds["dyadic_events"].collect())
    assert got == [("3", "7", 5, 7, False, "f"), ("9", "9", 1, 1, False, "f")]
    lost = sorted(r["line"] for r in rejects.collect())
    assert lost == sorted(["3|7|x|1.0", "|4|9|1.0", "1|2|6|many", "1|2|6", "z|a|8|1|extra"])
    who = {r["node_id"]: (r["first_observed_at"], r["last_observed_at"]) for r in ds["individuals"].collect()}
    assert who == {"3": (5, 7), "7": (5, 7), "9": (1, 1)} and ds["observation_windows"].count() == 3


def test_groups_of_a_file_and_an_empty_one(spark, tmp_path):
    layout = text.Layout("g string, n string, t long", {"group_event_id": "g", "node_id": "n", "start": "t", "end": "t + 5"}, ("group_event_id", "node_id"))
    for name, body in (("one", "g,n,t\nx,1.0,3\nx,1,2\nx,2,3\ny,,1\ny,4,1\n,5,1\ny,6,odd\n"), ("none", "g,n,t\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(body)
    ds, rejects = text.group_dataset(spark, "f", str(tmp_path / "one"), layout, ["group_event_id", "start", "end"])
    assert sorted((r["group_event_id"], r["start"], r["end"]) for r in ds["group_events"].collect()) == [("x", 2, 7), ("y", 1, 6)]
    assert sorted((r["group_event_id"], r["node_id"]) for r in ds["group_memberships"].collect()) == [("x", "1"), ("x", "2"), ("y", "4")] and rejects.count() == 3
    ds, rejects = text.group_dataset(spark, "f", str(tmp_path / "none"), layout, ["group_event_id", "start", "end"])
    assert ds["group_events"].count() == rejects.count() == ds["individuals"].count() == 0


def test_times_without_marks(spark):
    df = spark.createDataFrame([("19700101000001",), ("20240229235959",), ("20230229000000",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(text.micros_of_text(F.col("t"), "yyyyMMddHHmmss")).collect()]
    assert got == [1_000_000, 1_709_251_199_000_000, None, None, None]


def test_runs_of_one_state(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 20, "y"), ("a", 21, None), ("a", 22, None), ("b", 5, "x")]
    got = intervals.constant_runs(spark.createDataFrame(rows, "k string, t long, s string"), ["k"], "t", "s", 5)
    assert sorted(((r["k"], r["first"], r["last"], r["n"], r["s"], r["segment"]) for r in got.collect())) == [("a", 1, 2, 2, "x", 0), ("a", 3, 3, 1, "y", 0), ("a", 20, 20, 1, "y", 1), ("a", 21, 22, 2, None, 1), ("b", 5, 5, 1, "x", 0)]
