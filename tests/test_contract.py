"""The canonical contract: tables, checks, mappers, streams, features of histories and rules of labels."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators import history
from tidewater.sources import dataset, streams

SECOND = 1_000_000
PAIR = "event_id string, source_id string, target_id string, start long, end long, duration_seconds double, event_representation string, edge_semantics string, measurement_type string, measurement_value double, quality_flag string, location_id string, directed boolean"


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIR)


@pytest.fixture(scope="module")
def plain(spark):
    """A pair by duration and one by association."""
    rows = [("e1", "A", "B", 0, 10 * SECOND, 10.0, "interval", "sensor_proximity", "duration", 10.0, None, None, False),
            ("e2", "B", "C", 10 * SECOND, 20 * SECOND, 10.0, "aggregated_interval", "association", "association_index", 0.4, None, None, False)]
    return dataset.Dataset(spark, "d", {"individuals": spark.createDataFrame([("A",), ("B",), ("C",)], "node_id string"), "dyadic_events": pairs(spark, rows)})


@pytest.fixture(scope="module")
def grouped(spark):
    groups = spark.createDataFrame([("g1", 0, 10 * SECOND, 10.0), ("g2", 5, 5, 0.0)], "group_event_id string, start long, end long, duration_seconds double")
    members = spark.createDataFrame([("g1", n, 1.0) for n in "ABC"] + [("g2", "A", 1.0)], "group_event_id string, node_id string, membership_weight double")
    return dataset.Dataset(spark, "g", {"individuals": spark.createDataFrame([("A",), ("B",), ("C",)], "node_id string"), "group_events": groups, "group_memberships": members})


def test_tables_are_written_and_read(spark, plain, tmp_path):
    plain.notes = {"source": "test"}
    plain.write(str(tmp_path))
    got = dataset.read(spark, str(tmp_path))
    assert (got.dataset_id, got.ordered, got.notes) == ("d", True, {"source": "test"})
    for name in dataset.TABLES:
        assert [f.name for f in got[name].schema] == [f.name for f in dataset.empty(spark, name).schema]
        assert sorted(map(str, got[name].collect())) == sorted(map(str, plain[name].collect()))
    assert {r["name"]: (r["n"], r["first"], r["last"]) for r in got.summary().collect()}["dyadic_events"] == (2, 0, 20 * SECOND)
    assert spark.range(1).select(dataset.attributes(b=F.lit(2), a=F.lit("x"), c=F.lit(None).cast("string"))).first()[0] == '{"a":"x","b":2}'


def test_sound_tables_have_no_findings(plain, grouped):
    assert not dataset.has_errors(dataset.findings(plain)) and {r["n"] for r in dataset.findings(plain).collect()} == {0}
    assert {r["code"]: (r["n"], r["fraction"]) for r in dataset.findings(grouped).where("n > 0").collect()} == {"zero_group_duration": (1, 0.5)}
    assert dataset.group_sizes(grouped).first()[:4] == (2, 1, 2.0, 3)


def test_each_check_finds_its_fault(spark):
    ok = ("sensor_proximity", "duration")
    rows = [
        ("a", "A", "A", 0, SECOND, 1.0, "i", *ok, 1.0, None, None, False), ("a", "A", None, 0, SECOND, 1.0, "i", *ok, 1.0, None, None, False), ("b", "A", "Z", 5, 0, -1.0, "i", *ok, float("inf"), None, None, False),
        ("c", "A", "B", None, 4, 0.0, "i", *ok, None, f"x;{dataset.DUPLICATE}", None, False), ("d", "A", "B", 0, 9 * SECOND, 3.0, "i", *ok, float("nan"), None, None, False), (None, "A", "B", 0, 1, None, "i", *ok, 1.0, None, None, False),
        (None, "A", "B", 0, 1, None, "i", *ok, 1.0, None, None, False)]
    groups = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 2, 1, -1.0), ("h", None, 1, 0.0)], "group_event_id string, start long, end long, duration_seconds double")
    members = spark.createDataFrame([("g", "A"), ("g", "A"), ("k", "Y"), ("h", None)], "group_event_id string, node_id string")
    who = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "node_id string")
    ds = dataset.Dataset(spark, "x", {"individuals": who, "dyadic_events": pairs(spark, rows), "group_events": groups, "group_memberships": members})
    got = {r["code"]: (r["severity"], r["n"]) for r in dataset.findings(ds).collect()}
    want = {
        "duplicate_node_ids": 1, "missing_node_ids": 1, "duplicate_event_ids": 2, "self_loops": 1, "missing_endpoints": 1, "orphan_dyadic_nodes": 1, dataset.DUPLICATE: 1, "negative_duration": 1, "zero_duration": 1,
        "duration_coordinate_mismatch": 1, "reversed_time": 1, "missing_temporal_coordinates": 1, "non_finite_measurement": 3, "duplicate_group_ids": 1, "duplicate_group_membership": 1, "orphan_group_ids": 1,
        "orphan_group_members": 1, "missing_group_time": 1, "reversed_group_time": 1, "negative_group_duration": 1, "zero_group_duration": 1}
    assert {k: v for k, (_, v) in got.items()} == want and {k: s for k, (s, _) in got.items()} == dataset.SEVERITY
    assert dataset.has_errors(dataset.findings(ds))
    ds.ordered = False
    assert {r["severity"] for r in dataset.findings(ds).where("code = 'missing_temporal_coordinates'").collect()} == {"medium"}
    with pytest.raises(ValueError, match="no order"):
        dataset.require_order(ds)
    with pytest.raises(ValueError, match="place in time"):
        dataset.require_order(dataset.Dataset(spark, "e"))


def test_mappers_and_what_a_dataset_calls_for(spark, plain, grouped):
    one = streams.compiled(plain, "DurationContactMapper").pairs.collect()
    assert [(r["exposure_id"], r["rate"]) for r in one] == [("exposure:e1", 1.0)]
    two = streams.compiled(plain, "association").pairs.first()
    assert two["rate"] * 10 == pytest.approx(0.4)
    assert streams.primary_mapper(plain) == "association" and streams.primary_mapper(grouped) == "group_mixing"
    s = streams.primary(grouped)
    assert s.groups.count() == 1 and s.members.count() == 3 and s.groups.first()["mode"] == "frequency_dependent"
    kinds = [(f"e{k}", "A", "B", 0, SECOND, 1.0, "interval" if k < 40 else "fixed_bin", "sensor_proximity", f"kind{k}", 1.0, None, None, None) for k in range(41)]
    assert streams.primary_mapper(dataset.Dataset(spark, "k", {"dyadic_events": pairs(spark, kinds)})) == "detection"  # told by one of many kinds
    for name in ("DetectionIntervalMapper", "GroupMixingMapper", "no such mapper"):
        with pytest.raises(ValueError):
            streams.compiled(plain, name)
    with pytest.raises(ValueError):
        streams.primary_mapper(dataset.Dataset(spark, "e"))
    with pytest.raises(ValueError):
        streams.group_mixing(grouped, "other")


def test_unions_of_overlapping_exposures(spark):
    rows = [(f"e{k}", "A", "B", s, e, 0.0, "i", "sensor_proximity", "duration", 1.0, flag, place, False) for k, (s, e, flag, place) in enumerate(
        [(0, 5, None, None), (5, 9, None, None), (12, 14, None, None), (3, 4, None, None), (13, 20, None, "x"), (13, 20, dataset.DUPLICATE, None), (7, 7, None, None)])]
    ds = dataset.Dataset(spark, "d", {"dyadic_events": pairs(spark, rows)})
    got = sorted((r["start"], r["end"], r["origin"]) for r in streams.compiled(ds, "coalesced").pairs.collect())
    assert got == [(0, 9, '["e0","e3","e1"]'), (12, 14, '["e2"]'), (13, 20, '["e4"]')]
    s = streams.compiled(ds, "duration")
    s.pairs = s.pairs.withColumn("rate", F.when(F.col("origin") == "e1", 2.0).otherwise(1.0))
    with pytest.raises(PySparkException, match="different rates"):
        streams.coalesced(s).pairs.collect()


def test_streams_are_cut_restricted_and_joined(spark, grouped):
    s = streams.primary(grouped)
    cut = streams.sliced(s, 4 * SECOND, 6 * SECOND)
    assert [(r["start"], r["end"]) for r in cut.groups.collect()] == [(4 * SECOND, 6 * SECOND)] and cut.members.count() == 3
    assert streams.sliced(s, 10 * SECOND, 20 * SECOND).members.count() == 0
    few = lambda names: streams.restricted(s, spark.createDataFrame([(n,) for n in names], "node_id string"))
    assert few("AB").members.count() == 2 and few("AB").groups.count() == 1 and few("A").groups.count() == few("A").members.count() == 0
    e, m = streams.events(few("AB"), F.lit("n"))
    assert e.first()["divided"] and m.count() == 2
    both = streams.combined(s, streams.shifted(s, 1), streams.with_mode(s, "undiluted_clique"))
    assert both.groups.count() == 3 and both.members.count() == 3 and {r["node_id"] for r in both.nodes().collect()} == set("ABC")
    assert {r["n"] for r in streams.problems(s).collect()} == {0}
    s.groups = s.groups.withColumns({"rate": F.lit(-1.0), "group_event_id": F.lit("other"), "end": F.col("start")})
    assert {r["code"] for r in streams.problems(s).where("n > 0").collect()} == {"group_bad_rate", "group_no_length", "orphan_members"}


def test_variants_of_a_stream(spark):
    groups = spark.createDataFrame([(f"g{k}", k * 10, k * 10 + 4) for k in range(5)], "group_event_id string, start long, end long")
    members = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "b"), ("g3", "a")], "group_event_id string, node_id string")
    rows = [(f"e{k}", "a", "b", s, e, 1.0, "i", "sensor_proximity", "duration", 1.0, None, None, False) for k, (s, e) in enumerate([(3, 9), (25, 45)])]
    ds = dataset.Dataset(spark, "d", {"group_events": groups, "group_memberships": members, "dyadic_events": pairs(spark, rows)})
    s = streams.combined(streams.compiled(ds, "duration"), streams.compiled(ds, "group_mixing"))
    r = streams.replayed(s, 40, 60)
    assert sorted((x["start"], x["end"]) for x in r.groups.collect()) == [(40, 44), (50, 54)] and [(x["start"], x["end"]) for x in r.pairs.collect()] == [(45, 60)]
    who = spark.createDataFrame([("a", "s"), ("b", "t")], "node_id string, species string")
    h = streams.hosted(s, who, "s")
    assert sorted(x["group_event_id"] for x in h.groups.collect()) == ["g1", "g3"] and h.members.count() == 2 and h.pairs.count() == 0
    with pytest.raises(ValueError):
        streams.hosted(s, who, "other")
    f = streams.first_events(s, 2)
    assert sorted(x["group_event_id"] for x in f.groups.collect()) == ["g0", "g1"] and f.pairs.count() == 2 and f.members.count() == 2
    assert tuple(streams.extent(s).first()) == (0, 45) and tuple(streams.extent(streams.first_events(s, 0)).first()) == (None, None)


def test_a_coarse_clock_makes_nothing_more_recent(spark):
    from tidewater.operators import intervals

    df = spark.createDataFrame([(0, 10), (90, 130), (120, 130), (50, 50)], "s long, e long")
    of = lambda grain: [r[0] for r in df.select(intervals.coarse_decayed(F.col("s"), F.col("e"), 5, 100, 20.0, grain)).collect()]
    assert of(0) == pytest.approx([5 * 0.5 ** (92.5 / 20), 10 * 0.5 ** (5 / 20), 0.0, 0.0]) and of(20) == pytest.approx([5 * 0.5**5, 10 * 0.5, 0.0, 0.0])
    assert all(a >= b for a, b in zip(of(0), of(7), strict=True))


def test_bounds_and_individuals(spark, plain, grouped):
    w = {r["node_id"]: (r["window_start"], r["window_end"]) for r in dataset.windows_from_pairs(plain).collect()}
    assert w == {"A": (0, 10 * SECOND), "B": (0, 20 * SECOND), "C": (10 * SECOND, 20 * SECOND)}
    assert {r["node_id"] for r in dataset.windows_from_groups(grouped).collect()} == set("ABC")
    roster = spark.createDataFrame([("A", "f"), ("Q", None), ("A", "m"), ("", "f"), (None, "f")], "node_id string, sex string")
    made = dataset.with_bounds(dataset.individuals_from(plain, roster), dataset.windows_from_pairs(plain))
    got = {r["node_id"]: (r["sex"] is not None, r["first_observed_at"]) for r in made.collect()}
    assert got == {"A": (True, 0), "B": (False, 0), "C": (False, 10 * SECOND), "Q": (False, None)}


@pytest.mark.parametrize("paired", [512, 2])
def test_features_of_pairs_and_groups(spark, monkeypatch, paired):
    monkeypatch.setattr(history, "PAIRED", paired)  # partners of all groups as pairs, or those of large ones in maps
    rng = random.Random(paired)
    events, members = [], []
    for k in range(60):
        s = rng.randrange(0, 200)
        events.append((f"e{k}", "n", s * SECOND, (s + rng.randrange(0, 30)) * SECOND, rng.choice([1.0, 0.5]), rng.choice([None, "x", "y"])))
        members += [(f"e{k}", f"v{v}") for v in rng.sample(range(12), rng.choice([1, 2, 2, 3, 6]))]
    members += [members[0], ("e0", None)]
    labels = [("n", b * SECOND, (b + 60) * SECOND, f"v{v}") for b in (0, 70, 500) for v in range(9)]
    e = spark.createDataFrame(events, "event string, network string, start long, end long, rate double, location_id string")
    m, ls = spark.createDataFrame(members, "event string, node string"), spark.createDataFrame(labels, "network string, begin long, anchor long, node string")
    got = {(r["begin"], r["node"]): r for r in history.stream_features(e, m, ls, 20 * SECOND).collect()}
    assert len(got) == len(labels)
    of = {k: {n for i, n in members if i == k and n} for k in (x[0] for x in events)}
    for _, b, a, node in labels:
        mine = [(len(of[k]), max(s, b), min(t, a), rate, place, of[k]) for k, _, s, t, rate, place in events if node in of[k] and len(of[k]) > 1 and s < t and s < a and t > b]
        r, span, n = got[b, node], 60.0, len(mine)
        partners = set().union(*(x[5] for x in mine)) - {node}
        assert r["activity_count"] == n and r["observed_partner_count"] == len(partners) and r["location_count"] == len({x[4] for x in mine} - {None})
        assert r["eligible_partner_fraction"] == pytest.approx(len(partners & {f"v{v}" for v in range(9)}) / 8)
        assert r["contact_opportunity_rate"] == pytest.approx(sum((t - s) / SECOND * (k - 1) for k, s, t, *_ in mine) / span)
        assert r["weighted_exposure_rate"] == pytest.approx(sum((t - s) / SECOND * q for _, s, t, q, *_ in mine) / span)
        assert r["mean_group_size"] == pytest.approx(sum(x[0] for x in mine) / n if n else 0)
        last, first = max((x[2] for x in mine), default=b), min((x[2] for x in mine), default=b)
        assert r["recency_score"] == pytest.approx(max(0, 1 - (a - last) / SECOND / span))
        assert r["recent_activity_fraction"] == pytest.approx(sum(x[2] >= a - 30 * SECOND for x in mine) / n if n else 0)
        assert r["active_span_fraction"] == pytest.approx((last - first) / SECOND / span if n > 1 else 0)


def test_rules_of_labels(spark):
    row = lambda k, c, **v: (v.get("label", f"l{k}"), "n", 1, c, v.get("a", 0), 1, v.get("h", 2), v.get("value", 0.5), 0.5, v.get("population", 2))
    kinds = "label_id string, network string, anchor int, candidate string, a long, b long, c long, value double, share double, population long"
    get = lambda rows: {r["check"]: r["n"] for r in history.label_checks(spark.createDataFrame(rows, kinds), ["network", "anchor"], "candidate", "label_id", "population", "value", "share", ("a", "b", "c")).collect()}
    assert set(get([row(0, "x"), row(1, "y")]).values()) == {0}
    got = get([row(0, "x", value=2.0), row(1, "y", label="l0", h=1), row(2, "z", value=None)])
    assert got == {"no_missing_values": 1, "strict_time_order": 1, "value_ranges": 1, "unique_label_id": 1, "complete_candidate_coverage": 1}
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 2, 3)], "k string, v int, w int")
    assert sorted(map(tuple, history.constant_by_key(df, ["k"], ["v"]).collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(PySparkException, match="isn't constant"):
        history.constant_by_key(df.union(spark.createDataFrame([("a", 1, 5)], df.schema)), ["k"], ["w"]).collect()


def test_numbers_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", 7)
    df = spark.createDataFrame([(f"k{i % 50}",) for i in range(120)] + [(None,)], "k string")
    got = {r["k"]: r["i"] for r in ranks.numbered(df, "k", "i").collect()}
    assert sorted(got.values()) == list(range(1, 51)) and got == {r["k"]: r["i"] for r in ranks.numbered(df.repartition(9), "k", "i").collect()}
    x = spark.createDataFrame([(i, (i * 37 % 101) / 101) for i in range(1, 101)], "i long, u double")
    places = {r["i"]: r["position"] for r in ranks.hash_position(x, "u", "i").collect()}
    assert [i for i, _ in sorted(places.items(), key=lambda v: v[1])] == sorted(places, key=lambda i: (i * 37 % 101)) and list(itertools.islice(sorted(places.values()), 3)) == [1, 2, 3]
