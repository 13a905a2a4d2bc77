"""The similarity join against brute force."""

import random

import pyarrow as pa
import pytest

from tidewater.llm import jaccard_join


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        what = rng.random()
        if what < 0.6:
            words[k] = f"n{rng.randrange(10**6)}"
        elif what < 0.8:
            words.insert(k, f"n{rng.randrange(10**6)}")
        elif len(words) > 8:
            del words[k]
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for size, copies, most in ((320, 160, 22), (60, 60, 5), (12, 40, 2), (900, 25, 60)):
        base = rng.choices(vocabulary, k=size)
        made = [base]
        for _ in range(copies):
            made.append(edited(rng, rng.choice(made) if rng.random() < 0.5 else base, rng.randrange(most + 1)))
        for m in made:
            texts[len(texts)] = " ".join(m)
    shared = rng.choices(vocabulary, k=80)  # one passage in many texts of their own
    for _ in range(60):
        texts[len(texts)] = " ".join(rng.choices(vocabulary, k=30) + shared + rng.choices(vocabulary, k=rng.randrange(60)))
    for t in ("", None, "a", "A", "a b c", "A b  c", "a b c d e", "a b c d e f", "a b c d e f g h i", " \n\t ", "é É é É é", "é É é É é é"):
        texts[len(texts)] = t
    for k in range(4, 14):
        texts[len(texts)] = " ".join(vocabulary[:k])
    return texts


def test_components_are_those_of_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, sig string, cls int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute(texts)


def test_one_row_of_each_component_stays(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, key string")
    got = sorted(r.doc_id for r in jaccard_join.representatives(docs).collect())
    assert got == sorted({c for _, c in brute(texts).values()})


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long), (3, long), (3, long), (None, "x y"), (None, "x y"), (5, None), (5, ""), (7, long + " more"), (7, "other words altogether here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 3, 36), (3, 3, 36), (3, 3, 36), (None, None, 1), (None, None, 1), (5, 5, 0), (5, 5, 0), (7, 3, 37), (7, 7, 1)], key=str)
    left = sorted(((r.doc_id, r.text) for r in jaccard_join.representatives(docs).collect()), key=str)
    assert left == sorted([(3, long), (None, "x y"), (5, None), (5, ""), (7, "other words altogether here")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert jaccard_join.representatives(docs).count() == 0


def test_bands_cover_every_pair():
    low, segments, slack = jaccard_join.bands(4, 5)
    for n in range(4, 3000):
        k = int((low <= n).sum()) - 1
        for other in (n, n * 5 // 4):
            assert jaccard_join.most_apart(n, other, 4, 5) + 1 + slack[k] <= segments[k]


def test_long_group_keeps_all_members_over_a_batch_edge():
    n = jaccard_join.SMALL + 5
    smaller = [2 * k + 1 for k in range(n)]  # those that stand in the next smaller band come first
    own = [2 * k for k in range(n, n + 3)]
    batches = [pa.record_batch([pa.array([7] * len(m)), pa.array(m)], ["sig", "member"]) for m in (smaller, own)]
    reached = {x for b in jaccard_join._runs(iter(batches)) for c in (0, 1) for x in b.column(c).to_pylist()}
    assert reached == {m & ~1 for m in smaller + own}


def test_a_common_line_makes_no_members_of_large_groups(spark, monkeypatch):
    """Groups of a shared line alone are left out: each set still meets its links in small groups."""
    rng = random.Random(8)
    line = [f"common{k}" for k in range(6)]
    texts = {}
    for k in range(0, 400, 2):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts[k] = " ".join(own[:30] + line + own[30:])
        texts[k + 1] = " ".join(own[:30] + line + own[30:-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "_around_pivots", lambda *a: pytest.fail("a common line went on to pivots"))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {k: k - k % 2 for k in texts}
