"""Small cases of the network measures and fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import models, networks


def edges(spark, pairs, *keys):
    kinds = ", ".join([*(f"{k} string" for k in keys), "a long, b long, w double"])
    return networks.both_ways(spark.createDataFrame(pairs, kinds), "a", "b", F.col("w"), *keys)


def test_core_numbers_of_a_triangle_with_a_tail_and_of_a_long_path(spark):
    got = networks.k_core(edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (None, 5, 1.0), (5, 5, 1.0)])).collect()
    assert {r["node"]: r["core"] for r in got} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1}
    got = networks.k_core(edges(spark, [(k, k + 1, 1.0) for k in range(13)])).collect()
    assert {r["core"] for r in got} == {1}


def test_pagerank_and_eigenvector_reach_a_tolerance(spark):
    pairs = [("x", 1, 2, 2.0), ("x", 2, 3, 1.0), ("x", 3, 1, 4.0), ("x", 3, 4, 1.0), ("y", 1, 2, 1.0)]
    e = edges(spark, pairs, "g")
    lone = spark.createDataFrame([("x", 9), ("y", 1)], "g string, node long")
    got = {(r["g"], r["node"]): r["rank"] for r in networks.pagerank(e, ["g"], lone).collect()}
    names = [1, 2, 3, 4, 9]
    w = np.zeros((5, 5))
    for g, a, b, v in pairs:
        if g == "x":
            w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = v
    p = np.full(5, 0.2)
    for _ in range(500):
        s = w.sum(1)
        p = (0.15 + 0.85 * p[s == 0].sum()) / 5 + 0.85 * np.array([sum(p[i] * w[i, j] / s[i] for i in range(5) if s[i]) for j in range(5)])
    assert [got["x", n] for n in names] == pytest.approx(p.tolist(), abs=1e-9) and sum(v for (g, _), v in got.items() if g == "x") == pytest.approx(1)
    assert got["y", 1] == pytest.approx(0.5) and got["y", 2] == pytest.approx(0.5)
    got = {(r["g"], r["node"]): r["score"] for r in networks.eigenvector(e, ["g"]).collect()}
    lead = np.abs(np.linalg.eigh(w[:4, :4])[1][:, -1])
    assert [got["x", n] for n in names[:4]] == pytest.approx(lead.tolist(), abs=1e-8) and got["y", 1] == pytest.approx(0.5**0.5)
    with pytest.raises(RuntimeError):
        networks.pagerank(e, ["g"], most=4)


def test_names_of_nodes_keep_their_digits(spark):
    from tidewater.sources import contract

    of = lambda values, kind: [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(contract.node_id(F.col("v"))).collect()]
    assert of([10_000_000, 12_345_678, 2**60 + 1, None], "long") == ["10000000", "12345678", str(2**60 + 1), ""]
    assert of([12_345_678.0, 7.0, 1.5], "double") == ["12345678", "7", "1.5"] and of([" 7.0 ", "a.0", "x"], "string") == ["7", "a", "x"]


def test_best_by_value_and_nulls_in_scores(spark):
    from tidewater.operators import policies

    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", None, 2.0), ("c", 3.0, 3.0), ("c", None, 4.0)], "g string, v double, s double")
    got = policies.evaluate_scores(df, ["g"], "v", ["s"], 0.5).first()
    assert (got["n"], got["k"], got["selected_value"], got["oracle_value"], got["random_value"]) == (2, 1, 3.0, 3.0, 2.0)
    x = spark.createDataFrame([(5, 10.0), (5000, 10.001)], "node long, v double").agg(F.max_by("node", F.struct("v", -F.col("node"))))
    assert x.first()[0] == 5000


def test_tables_that_should_agree(spark):
    from tidewater.operators import contrasts

    of = lambda rows: spark.createDataFrame(rows, "k long, v double")
    a = [(1, 1.0), (2, 2.0), (None, 3.0)]
    get = lambda x, y, t=0.0: contrasts.reconstruction(of(x), of(y), ["k"], "v", t).first().asDict()
    assert get(a, a) == {"matched": 3, "left_only": 0, "right_only": 0, "repeated": 0, "largest": 0.0, "agree": True}
    assert not get(a, a[:2])["agree"] and not get(a, [*a, (1, 1.0)])["agree"] and get(a, [*a, (1, 1.0)])["repeated"] == 1
    off = [(1, 1.25), *a[1:]]
    assert get(a, off)["largest"] == 0.25 and not get(a, off)["agree"] and get(a, off, 0.3)["agree"] and not get(a, [(1, None), *a[1:]])["agree"]


def test_a_query_has_a_name_of_its_own():
    from tidewater.plans.catalogue import query

    with pytest.raises(ValueError, match="already"):
        @query()
        def int_coalesce(spark, sf_dir):
            """Another one."""


def test_means_over_the_first_blocks(spark):
    from tidewater.operators import statistics

    df = spark.createDataFrame([("g", "a", 2, 1.0), ("g", "a", 5, 3.0), ("g", "a", 9, 8.0), ("g", "b", 5, 4.0), ("g", "b", 9, None)], "g string, i string, b long, v double")
    got = {(r["i"], r["level"]): (r["m"], r["final"]) for r in statistics.prefix_means(df, ["g"], "i", "b", "v").collect()}
    assert got == {("a", 1): (1.0, 4.0), ("a", 2): (2.0, 4.0), ("a", 3): (4.0, 4.0), ("b", 2): (4.0, 4.0), ("b", 3): (4.0, 4.0)}


def test_singular_systems_have_no_coefficients(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.0), (2, None, 1.0)], "g long, y double, x double")
    assert all(r["coefficients"] is None for r in models.ridge_without_each(df, "g", "y", ["x"], 0.0).collect())


def test_summaries_of_small_cases(spark):
    from tidewater.operators import summaries

    c = spark.createDataFrame([("f", "a", 1.0), ("f", "a", 1.0), ("f", "b", None)], "family string, kind string, d double")
    got = {r["kind"]: r for r in summaries.spread(c, ["family", "kind"], "d").collect()}
    assert got["a"]["size"] == 2 and got["a"]["n_values"] == 1 and got["a"]["spread"] == 0.0
    assert got["b"]["size"] == 0 and got["b"]["spread"] is None
    n = spark.createDataFrame([("x", 1, 5), ("x", 2, 3), ("x", 3, None), ("y", 1, 2), ("y", 2, 4)], "node string, level int, t int")
    assert {r["node"]: (r["levels"], r["nested"]) for r in summaries.nested(n, ["node"], "level", "t").collect()} == {"x": (2, True), "y": (2, False)}
    m = spark.createDataFrame([("k", "g", 60), ("k", "g", 60), ("k", "h", 60)], "kind string, g string, s int")
    assert abs(summaries.mean_competitors(m, ["kind"], "g", "s").first()["competitors"] - 2 / 3) < 1e-12
    p = spark.createDataFrame([(0.5, 1, 2.0, 1.0, 0), (0.5, 0, 4.0, 1.0, 0)], "c double, came int, e double, o double, w int")
    assert summaries.prediction_scores(p, [], "c", "came", "e", "o", "w").first()[1:] == (0.25, 2.0)


def test_means_settle_as_blocks_are_added(spark):
    from tidewater.operators import statistics

    rows = [("g", i, b, float(v)) for i, values in {"a": (1, 3, 2), "b": (0, 5, 7), "c": (2, 0, 1)}.items() for b, v in zip((10, 20, 40), values, strict=True)]
    rows += [("g", "d", 40, 9.0), ("g", "e", 10, None), ("h", "a", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, i string, b long, v double")
    got = {(r["g"], r["level"]): r for r in statistics.precision_curve(df, ["g"], "i", "b", "v", 2).collect()}
    assert set(got) == {("g", 1), ("g", 2), ("g", 3), ("h", 1)}
    assert [got["g", k]["items"] for k in (1, 2, 3)] == [3, 3, 4] and got["g", 3]["top_overlap"] == 1.0 and got["g", 3]["spearman"] == pytest.approx(1)
    assert got["g", 1]["reliability"] is None and got["g", 1]["zero_share"] == pytest.approx(1 / 3) and got["g", 1]["spearman"] == pytest.approx(-1) and got["g", 1]["top_overlap"] == 0.5
    v = np.array([(1, 3, 2), (0, 5, 7), (2, 0, 1)], float)
    between, within = 3 * v.mean(1).var(ddof=1), v.var(1, ddof=1).mean()
    icc = (between - within) / (between + 2 * within)
    assert got["g", 3]["reliability"] == pytest.approx(3 * icc / (1 + 2 * icc) if icc > 0 else 0.0)
    assert got["h", 1]["spearman"] is None and got["h", 1]["items"] == 1


def test_products_in_many_blocks_and_chunks_equal_plain_sums_and_move_no_edges(spark, monkeypatch):
    from tidewater.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 5)
    monkeypatch.setattr(blocks, "CHUNK", 3)
    pairs = [(a, b, float(1 + (a * b) % 7)) for a in range(40) for b in range(40) if a != b and (a + b) % 3]
    edges = spark.createDataFrame(pairs, "node long, partner long, w double")
    place = blocks.placed(edges.select("node").distinct(), []).cache()
    assert place.select("block").distinct().count() > 3
    held = blocks.chunks(networks._edges_of(edges, place, [], F.col("w")))
    state = place.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda v: v["node"].cast("double")).alias("x"))
    made = blocks.product(held, state)
    got = {r["node"]: r["y"] for r in blocks.spread(made.select("block", F.col("y").alias("x")), place, [], "y").collect()}
    want = dict.fromkeys(range(40), 0.0)
    for a, b, w in pairs:
        want[b] += w * a
    assert got == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan  # the edges stay where they are
    held.unpersist()
