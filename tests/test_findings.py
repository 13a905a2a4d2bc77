"""Cases that the review of round 3 found."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import keyed
from tidewater.operators import exposure, history, partners, resampling, temporal
from tidewater.plans import catalogue, structure  # noqa: F401

SCHEMA = "event_id long, ts string, user_id long, event_type string, value double, props string"


@pytest.fixture
def against_sql(spark, tmp_path):
    """Compares a query with its SQL over given events."""

    def compare(name, rows):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        found = con.execute(catalogue.ORACLES[name])
        names = [d[0] for d in found.description]
        want = sorted(map(repr, found.fetchall()))
        assert want == sorted(repr(tuple(r[c] for c in names)) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
        return want

    return compare


def test_contacts_without_length_are_edges(against_sql):
    rows = [(i, f"2024-01-0{1 + i % 7} 0{i % 9}:00:00", 200 + i % 5, "click", 0.0 if i % 3 == 0 else 1.5, "") for i in range(40)]
    assert len(against_sql("set_edge_retention", rows)) == 2


def test_sums_are_compared_as_they_are(against_sql):
    rows = []
    for user, p, c in ((1, (0.1, 0.2), (0.3,)), (2, (0.3,), (0.1, 0.2)), (3, (0.5,), (0.5,)), (4, (2.0,), (5.25,))):
        rows += [(0, "2024-01-01 00:00:00", user, "purchase", v, "") for v in p] + [(0, "2024-01-01 00:00:00", user, "click", v, "") for v in c]
    assert against_sql("jn_increments", rows) == ["(1, 0.0, True)", "(2, -0.0, False)", "(3, 0.0, False)", "(4, -3.25, False)"]


def test_draws_are_dealt_to_tasks_in_blocks(spark, monkeypatch):
    """The same result whatever the blocks, and against a plain loop over the keyed numbers."""
    values = {(f, u): float(f * 10 + u * u % 7) for f in range(3) for u in range(5 + 6 * f)}
    df = spark.createDataFrame([("g", f, u, v) for (f, u), v in values.items()], "g string, f long, u long, v double")
    whole = resampling.multilevel_bootstrap(df, ["g"], ["f", "u"], "v", 4, 9).first()
    monkeypatch.setattr(resampling, "BLOCK", 3)
    monkeypatch.setattr(resampling, "FEW", 10)
    asked = []
    parts = resampling._parts
    monkeypatch.setattr(resampling, "_parts", lambda *a: asked.append(parts(*a)) or asked[-1])
    dealt = resampling.multilevel_bootstrap(df, ["g"], ["f", "u"], "v", 4, 9).first()
    assert max(asked) > 1 and dealt["low"] == pytest.approx(whole["low"]) and dealt["high"] == pytest.approx(whole["high"])
    keys = [(r, "", q, 3, "0") for r in range(4) for q in range(3)] + [(r, str(f), q, 5 + 6 * f, "1") for r in range(4) for f in range(3) for q in range(60)]
    u = spark.createDataFrame(keys, "r int, f string, q long, n long, k string")
    place = {(r["r"], r["f"], r["q"]): r["i"] for r in u.select("r", "f", "q", F.floor(keyed.uniform(9, F.lit("g"), F.col("r"), F.col("k"), F.col("f"), F.col("q")) * F.col("n")).alias("i")).collect()}
    means = []
    for r in range(4):
        drawn = [place[r, "", q] for q in range(3)]
        means.append(sum(values[f, place[r, str(f), q]] / 3 / (5 + 6 * f) for f in set(drawn) for q in range(drawn.count(f) * (5 + 6 * f))))
    assert [dealt["low"], dealt["high"]] == pytest.approx(list(np.percentile(means, [2.5, 97.5])))


@pytest.mark.parametrize("paired", [1, 4, 128])
def test_partners_are_counted_in_tiles(spark, monkeypatch, paired):
    for name, value in (("PAIRED", paired), ("PIECE", 64), ("TILES", 3), ("MERGED", 5)):
        monkeypatch.setattr(partners, name, value)
    groups = {f"g{k}": {(k * 37 + j * j * (k % 5 + 1)) % 150 for j in range(1 + k % 9)} for k in range(40)}
    df = spark.createDataFrame([(g, v) for g, m in groups.items() for v in m], "group_id string, node_id long").repartition(3)
    want = {v: (len({x for m in groups.values() if v in m for x in m} - {v}), 60.0 * sum(v in m and len(m) > 1 for m in groups.values())) for m in groups.values() for v in m if len(m) > 1}
    assert {r["node"]: (r["degree"], r["strength"]) for r in exposure.group_strength(df, 60.0).collect()} == want


def test_features_shuffle_no_maps_of_nodes(spark):
    e = spark.createDataFrame([("e", "n", 0, 10, 1.0, None), ("f", "n", 5, 20, 1.0, None)], "event string, network string, start long, end long, rate double, location_id string")
    m = spark.createDataFrame([("e", "a"), ("e", "b"), ("f", "a"), ("f", "c")], "event string, node string")
    labels = spark.createDataFrame([("n", 0, 30, v) for v in "abd"], "network string, begin long, anchor long, node string")
    x = history.stream_features(e, m, labels, 10)
    assert "bitmap_or_agg" not in x._jdf.queryExecution().toString()
    assert {r["node"]: (r["observed_partner_count"], r["eligible_partner_fraction"]) for r in x.collect()} == {"a": (2, 0.5), "b": (1, 0.5), "d": (0, 0.0)}


def test_reach_goes_by_blocks_of_origins_and_writes_no_bits(spark, monkeypatch):
    """Against sets of origins; several blocks and tiles, rows that are empty or full, and shuffled orders."""
    rng = np.random.default_rng(3)
    rows = [(k % 4 + 1, f"p{k}", int(v), 2) for k in range(260) for v in rng.choice(200, 2, replace=False)]
    rows += [(b, f"g{b}", int(v), 40) for b in (2, 3) for v in rng.choice(200, 40, replace=False)]
    held = spark.createDataFrame([("n", 0, 9, *r, 1.0) for r in rows], "network string, begin long, anchor long, batch int, event string, node long, n long, weight double")
    order = temporal.orders(held, 1, 7)
    want, turns = {}, {}
    for r in order.collect():
        turns.setdefault((r["direction"], r["replicate"]), []).append((r["turn"], r["batch"]))
    for run, places in turns.items():
        known = {v: {v} for _, _, v, _ in rows}
        for _, batch in sorted(places):
            by: dict = {}
            for _, e, v, _ in (r for r in rows if r[0] == batch):
                by.setdefault(e, []).append(v)
            new = {v: set(x) for v, x in known.items()}
            for members in by.values():
                for v in members:
                    new[v] |= set().union(*(known[u] for u in members))
            known = new
        want.update({(*run, v): (len(x) - 1) / (len(known) - 1) for v, x in known.items()})
    names = []
    kept = temporal.Turns.kept
    monkeypatch.setattr(temporal.Turns, "kept", lambda self, df, name, *a: names.append(name) or kept(self, df, name, *a))
    monkeypatch.setattr(temporal, "READ", 3)
    monkeypatch.setattr(temporal, "WIDTH", 1)
    for tiles in (1, 3):
        monkeypatch.setattr(temporal, "TILES", tiles)
        got = {(r["direction"], r["replicate"], r["node"]): r["reached"] for r in temporal.reach(held, order).collect()}
        assert got == pytest.approx(want)
    assert "state" not in names
