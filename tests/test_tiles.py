"""Contact of pairs in tiles of nodes, against plain loops."""

import numpy as np
import pytest

from tidewater.operators import exposure, policies, temporal, tiles

GROUPS = {f"g{k}": {(k * 37 + j * j * (k % 5 + 1)) % 90 for j in range(1 + k % 30)} for k in range(40)}
LOOP = {}
for held in GROUPS.values():
    for x in held:
        for y in held - {x}:
            many, contact = LOOP.get((x, y), (0, 0.0))
            LOOP[x, y] = many + 1, contact + 60 / (len(held) - 1)


@pytest.fixture
def members(spark, monkeypatch):
    for name, value in (("WIDTH", 16), ("BLOCKS", 3), ("ADDED", 7), ("SENT", 5)):
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr(tiles, "pays", lambda *_: True)
    return spark.createDataFrame([(g, v) for g, m in GROUPS.items() for v in m] + [(None, 1), (None, 2)], "group_id string, node_id long").repartition(3)


def test_pairs_are_added_up_in_tiles_and_not_shuffled(members, monkeypatch):
    found = exposure.group_pairs(members, 60.0)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): (r["n_events"], pytest.approx(r["contact_seconds"])) for r in found.collect()}
    assert got == {k: v for k, v in LOOP.items() if k[0] < k[1]}
    monkeypatch.setattr(tiles, "pays", lambda *_: False)
    joined = {(r["a"], r["b"]): (r["n_events"], r["contact_seconds"]) for r in exposure.group_pairs(members, 60.0).collect()}
    assert got == joined


def test_tiles_pay_where_groups_are_large(spark):
    of = lambda n: spark.range(n).selectExpr("'g' as group_id", "id as node_id")
    assert [tiles.pays(tiles.sizes(of(n)), of(n).select("node_id")) for n in (1, 10, 100)] == [False, False, True]


def test_rows_without_a_node_dilute_but_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "pays", lambda *_: True)
    rows = [("g", 1), ("g", 2), ("g", None), ("h", 3), ("h", None)]
    got = exposure.group_pairs(spark.createDataFrame(rows, "group_id string, node_id long"), 10.0).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 5.0)]


def test_coverage_by_tiles_is_that_of_pairs(members, monkeypatch):
    got = policies.group_coverage(members, 60.0, 4, 5).collect()
    monkeypatch.setattr(tiles, "pays", lambda *_: False)
    assert sorted(map(tuple, got)) == sorted(map(tuple, policies.group_coverage(members, 60.0, 4, 5).collect()))
    chosen, cover = [], {}
    for r in sorted(got, key=lambda r: r["position"]):
        gain = {n: sum(max(0, w - cover.get(v, 0)) for (m, v), (_, w) in LOOP.items() if m == n and v not in chosen) for n in {x for x, _ in LOOP} - set(chosen)}
        assert gain[r["node"]] == pytest.approx(max(gain.values()))
        chosen.append(r["node"])
        for (m, v), (_, w) in LOOP.items():
            if m == r["node"]:
                cover[v] = max(cover.get(v, 0), w)


def test_tiles_of_reach_read_a_batch_in_pieces():
    """The same counts whatever the pieces, which are read from files; groups act at once, and pairs meet twice."""
    rng = np.random.default_rng(5)
    rows = [(b, False, rng.integers(0, 60, (40, 2))) for b in (1, 2, 3) for _ in range(3)] + [(2, True, np.stack([np.repeat([5, 9], 12), rng.integers(0, 60, 24)], axis=1))]
    rows = [(b, g, x[x[:, 0] != x[:, 1]] if not g else x) for b, g, x in rows]
    want = {v: {v} for _, g, x in rows for v in (x[:, 1] if g else x.ravel()).tolist()}
    for batch in (1, 2, 3):
        new = {v: set(x) for v, x in want.items()}
        for b, g, x in rows:
            for met in ([x[x[:, 0] == k, 1].tolist() for k in (5, 9)] if g else x.tolist()) if b == batch else []:
                for v in met:
                    new[v] |= set().union(*(want[u] for u in met))
        want = new
    for piece in (7, 50, 1 << 20):
        to, back = {}, {}
        for tile in range(2):
            runs = {("receive", 0): [(1, 1), (2, 2), (3, 3)], ("broadcast", 0): [(1, 3), (2, 2), (3, 1)]}
            nodes, found, n = temporal._tile_counter(1 << 20, 1, 5, piece)(iter(rows), runs, tile, 2)
            to.update(zip(nodes.tolist(), found[0].tolist(), strict=True))
            back.update(zip(nodes.tolist(), found[1].tolist(), strict=True))
        assert n == len(want) and to == {v: sum(v in x for x in want.values()) for v in want} and back == {v: len(x) for v, x in want.items()}
