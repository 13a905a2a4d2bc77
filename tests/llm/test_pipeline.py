"""Each stage of the pipeline against brute force, on a corpus with nulls, repeated rows and clashing columns."""

import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidewater.llm import mixing, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, cls long, key string, place long, doc string"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(900)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, line(25)) for k in range(6)]
    texts = [(i, "\n".join(line(rng.randrange(8, 20)) for _ in range(rng.randrange(2, 6))) + ("\nRead more on  our site" if i % 3 == 0 else "")) for i in range(150)]
    base = line(60)
    texts += [(200 + k, base) for k in range(12)]  # exact copies
    texts += [(220 + k, base.replace(" w", f" x{k} w", 1)) for k in range(10)]  # near ones
    texts += [(240, line(30) + " " + items[1][1] + " " + line(30)), (241, line(9) + "\n" + items[2][1].upper())]
    texts += [(250, None), (251, ""), (252, "too short"), (253, "again and again and over " * 20), (260, line(2500)), (None, line(40)), (None, line(40)), (261, line(30))]
    texts += [(261, texts[-1][1])]  # a repeated row
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i == 5 else f"src{(i or 0) % 5}", len(t) if t is not None else None, 1, 2, "k", 3, "d") for i, t in texts]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), items


def quality(docs):
    hosts, seen = {}, {}
    key = lambda x: " ".join(words(x.lower()))
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    for d in docs:
        hosts.setdefault(d.source, set()).add(d.text or "")
        for x in lines(d.text):
            seen.setdefault((d.source, key(x)), set()).add(d.text)
    bad = {k for k, v in seen.items() if len(v) >= 10 and len(v) * 100 > len(hosts[k[0]]) * 5}
    made = Counter()
    for d in docs:
        w = words(d.text)
        win = [tuple(w[k: k + 5]) for k in range(len(w) - 4)]
        n = Counter(win)
        again = len({k + j for k, v in enumerate(win) if n[v] > 1 for j in range(5)})
        if len(w) < 10 or again * 100 > 20 * len(w):
            continue
        left = "\n".join(x for x in d.text.split("\n") if (d.source, key(x)) not in bad)
        if (len(w) - len(words(left))) * 100 <= 70 * len(w):
            made[d.doc_id, left] += 1
    return made


def groups(docs):
    sets = []
    for d in docs:
        w = (d.text or "").lower().split()
        sets.append({tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return label


def test_stages_one_by_one(spark, sf):
    top, items = sf
    docs = spark.read.parquet(f"{top}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    held = [docs]
    for name in stages:
        out = stages[name](spark, held[-1], top)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{top}/after-{name}.parquet")
        held.append(spark.read.parquet(f"{top}/after-{name}.parquet"))
    rows = [h.collect() for h in held]

    assert Counter((r.doc_id, r.text) for r in rows[1]) == quality(rows[0])
    assert not [r for r in rows[1] if "more on" in r.text] and {200, 220, 260, 261, None} <= {r.doc_id for r in rows[1]}
    assert all(r.n_chars == len(r.text) for r in rows[1])

    label = groups(rows[1])
    assert len(rows[2]) == len(set(label))
    kept = {(r.doc_id, r.text) for r in rows[2]}
    for g in set(label):
        mine = [r for r, x in zip(rows[1], label, strict=True) if x == g]
        best = min((r.doc_id is None, r.doc_id or 0) for r in mine)
        assert any((r.doc_id is None, r.doc_id or 0) == best and (r.doc_id, r.text) in kept for r in mine)

    dirty = {(r.doc_id, r.text) for r in rows[2] if any(t.lower() in " ".join(r.text.lower().split()) for _, t in items)}
    assert len(dirty) == 2 and {(r.doc_id, r.text) for r in rows[3]} == kept - dirty

    n = lambda rs: sum(len(words(r.text)) for r in rs)
    assert Counter(map(tuple, rows[4])) <= Counter(map(tuple, rows[3]))
    leaf = lambda r: (f"domain{int(r.source[3:]) % 4}" if r.source else "none", r.lang, r.source)
    supply = Counter()
    for r in rows[3]:
        supply[leaf(r)] += len(words(r.text))
    given = mixing.allocate(dict(supply), queries.WEIGHTS, int(0.8 * supply.total()), 1)
    for of, tokens in given.items():
        mine = [r for r in rows[4] if leaf(r) == of]
        longest = max((len(words(r.text)) for r in mine), default=0)
        assert tokens - 1 <= n(mine) < tokens + longest + 1

    size = {r.doc_id: len(r.text.encode()) + 16 for r in rows[4]}
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
    per = Counter()
    for r in rows[5]:
        per[r.shard] += r.size
    assert all(abs(per[s] - sum(per.values()) / 40) <= max(size.values()) for s in range(40))


def test_run_and_empty_tables(spark, sf, tmp_path):
    top, _ = sf
    found = corpus_pipeline.run(spark, top)
    assert found.count() > 20 and found.columns[:2] == ["doc_id", "size"]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
