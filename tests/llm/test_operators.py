"""The other operators against brute force, round trips and planted cases; nulls, ties and empty tables."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import pytest

from tidewater.llm import cross_entropy, decontaminate, licences, line_rules, mixing, sharding, token_orc, toxicity, url_list

#: Further columns with names that operators use themselves.
CLASH = "doc_id long, text string, source string, lang string, row long, host string, key string"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, "h", "k") for i, t, s in rows], CLASH)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60))) + ("\nSubscribe  NOW to our letter" if i % 4 == 0 else ""), f"s{i % 3}") for i in range(120)]
    rows += [(200, None, "s0"), (201, "", None), (None, "a b c d e a b c d e a b c d e", "s1"), (202, "x\nx\ny #*$", "s2"), (202, "x\nx\ny #*$", "s2"), (203, "é " * 30, "s1"), (204, "long " + "word " * 3000, None)]
    return rows


def base(t):
    w, t = words(t), t or ""
    win = [tuple(w[k: k + 5]) for k in range(len(w) - 4)]
    n = Counter(win)
    hit = {k + j for k, v in enumerate(win) if n[v] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_base_rules_and_boilerplate(spark, corpus):
    limits = line_rules.Limits(min_docs=5, max_share=10, enough=10**6)
    got = line_rules.line_rules(table(spark, corpus), limits=limits).collect()
    want = Counter((i, *base(t)) for i, t, _ in corpus)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    removed = {r.doc_id: r.n_removed_words for r in got}
    assert all(removed[i] == (5 if i % 4 == 0 else 0) for i in range(120))
    kept = line_rules.clean(table(spark, corpus), limits=limits)
    assert kept.columns == [c.split()[0] for c in CLASH.split(", ")]
    assert not kept.where("text like '%Subscribe%'").count()
    good = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in kept.collect()} == good


def test_shards_are_even_and_slots_gapless(spark, corpus):
    got = sharding.shard_by_bytes(table(spark, corpus), 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(r.size for r in got if r.shard == s) - total / 7) <= largest for s in range(7))


def test_toxic_texts_are_told_on_ids_that_training_never_saw(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [f"plain{rng.randrange(200)}" for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = f"vile{rng.randrange(6)}"
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    rows += [(None, "plain1 vile1", "s"), (1001, None, "s"), (1002, "", "s")]
    out = toxicity.toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held if r.doc_id < 900]) > 0.95
    empty = [r.score for r in out if r.doc_id in (1001, 1002)]
    assert empty[0] == empty[1] < 0.7


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n))
    items = [(k, text(30)) for k in range(20)] + [(90, None), (91, "")]
    changed = list(items[3][1])
    for at in range(10, len(changed), 25):
        changed[at] = "z"
    rows = [(k, text(80), "s") for k in range(30)] + [(100, text(20) + " " + items[2][1] + " " + text(20), "s"), (101, text(9) + " " + "".join(changed), "s"), (102, items[4][1].upper().replace(" ", "\n"), "s"), (None, items[5][1], "s"), (103, None, "s"), (104, "", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, rows), bench).collect()}
    assert got == {(100, 2), (101, 3), (102, 4), (None, 5)}
    left = {r.doc_id for r in decontaminate.decontaminated(table(spark, rows), bench).collect()}
    assert left == {i for i, _, _ in rows} - {100, 101, 102, None}


def test_items_of_every_length_are_found_within_their_edits(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items, rows = [], []
    for m in range(1, 131):
        item = "".join(rng.choices(letters, k=m))
        items.append((m, item))
        text, edits = list(item), m // 10 if m < 96 else 9
        for k in range(edits):
            text[(2 * k + 1) * m // (2 * edits)] = rng.choice("0123456789")
        rows.append((m, " " + "".join(text) + " ", "s"))
    items.append((None, "NOTHING ELSE HERE IS LIKE THIS 1234567890 AT ALL"))
    rows.append((1000, "x nothing else here is like this 1234567890 at all", "s"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(m, m) for m in range(1, 131)} | {(1000, None)} <= got

    def apart(item, text):  # least edits against any part of the text
        cost = [0] * (len(text) + 1)
        for j, c in enumerate(item):
            new = [j + 1]
            for i, d in enumerate(text):
                new.append(min(cost[i] + (c != d), cost[i + 1] + 1, new[i] + 1))
            cost = new
        return min(cost)

    short = [(i, t) for i, t in items if i is not None and i < 40]
    want = {(d, i) for d, t, _ in rows for i, item in short if apart(item, t) <= len(item) // 10}
    assert {(d, i) for d, i in got if i is not None and i < 40} == want


def test_exact_excerpts_are_found_at_every_offset(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    text_of = lambda n: "".join(rng.choices(letters, k=n))
    items = [(1, text_of(417)), (2, text_of(300)), (3, text_of(60))]
    rows, want = [], set()
    for length in (48, 49, 56, 64, 80, 96, 130):
        for item, text in items[:2]:
            for a in range(0, len(text) - length + 1, 1 if length < 50 else 7):
                rows.append((len(rows), f"{text_of(30)}#{text[a: a + length].upper()}#{text_of(20)}", "s"))
                want.add((len(rows) - 1, item))
    rows.append((10**6, text_of(40) + items[2][1][3:55] + "é" + text_of(9), "s"))
    want.add((10**6, 3))
    clean = [(2 * 10**6 + k, f"{text_of(50)}#{items[0][1][k * 9: k * 9 + 38]}#{text_of(50)}", "s") for k in range(40)]  # too short a part
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(spark, rows + clean), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    one = next(r for r in got if r.doc_id == 10**6)
    assert (one.edits, one.first, one.last) == (0, 40, 92)
    left = {r.doc_id for r in decontaminate.decontaminated(table(spark, rows + clean), bench).collect()}
    assert left == {i for i, _, _ in clean}


def test_entries_hold_from_their_date_until_the_next_change(spark):
    day = lambda d: datetime(2024, 1, d)
    entries = [("host", "bad.example.com", "add", day(5)), ("host", "bad.example.com", "remove", day(10)), ("domain", "evil.org", "add", day(3)), ("url", "ok.net/x?y=1", "add", day(1)), ("url", "tie.net/a", "add", day(2)), ("url", "tie.net/a", "remove", day(2)), ("host", None, "add", day(1)), ("host", "late.com", "add", None)]
    shots = [(1, "http://bad.example.com/p", day(4)), (2, "https://www.BAD.example.com:80/p", day(5)), (3, "http://bad.example.com/", day(9)), (4, "http://bad.example.com/", day(10)), (5, "http://a.b.evil.org/", day(30)), (6, "http://notevil.org/", day(30)), (7, "http://ok.net/x?y=1#f", day(2)), (8, "http://tie.net/a", day(3)), (9, None, day(3)), (10, "http://a.evil.org", None), (None, "//u@evil.org", day(4)), (11, "http://late.com/", day(9))]
    e = spark.createDataFrame(entries, "kind string, key string, action string, at timestamp")
    s = spark.createDataFrame([(*r, 0) for r in shots], "page_id long, url string, fetched_at timestamp, host int")
    got = {r.page_id: (r.blocked, r.listed_as) for r in url_list.judge(s, e).collect()}
    hits = {2: "host", 3: "host", 5: "domain", 7: "url", None: "domain"}
    assert got == {i: (i in hits, hits.get(i)) for i, _, _ in shots}
    assert url_list.judge(s.limit(0), e).count() == 0 and not url_list.judge(s, e.limit(0)).where("blocked").count()


def plain_losses(rows):
    """Losses by plain counting of rows (id, text, role, fold)."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    ends = lambda t: ["|", *words(lower(t)), "|"]
    uni, bi = {}, {}
    for f in (0, 1):
        for role in (1, 2):
            u, b = uni[f, role], bi[f, role] = Counter(), Counter()
            for _, t, r, fold in rows:
                if r == role and fold != f:
                    w = ends(t)
                    u.update(w[1:])
                    b.update(zip(w, w[1:], strict=False))
    made = Counter()
    for i, t, _, f in rows:
        w, loss = ends(t), []
        ids = len(set(uni[f, 1]) | set(uni[f, 2])) + 1  # and the unknown word
        for role in (1, 2):
            u, b = uni[f, role], bi[f, role]
            p = [(b[x, y] + 50 * (u[y] + 1) / (u.total() + ids)) / (u[x] + 50) for x, y in zip(w, w[1:], strict=False)]
            loss.append(-sum(map(math.log, p)) / len(p))
        made[i, len(w) - 2, round(loss[0], 5), round(loss[0] - loss[1], 5)] += 1
    for f in (0, 1):  # p sums to 1 over the shared vocabulary and the unknown word
        every = set(uni[f, 1]) | set(uni[f, 2]) | {None}
        for u, b in ((uni[f, 1], bi[f, 1]), (uni[f, 2], bi[f, 2])):
            total = sum((b["|", y] + 50 * (u[y] + 1) / (u.total() + len(every))) / (u["|"] + 50) for y in every)
            assert total == pytest.approx(1)
    return made


def losses(df):
    return Counter((r.doc_id, r.n_tokens, round(r.target_loss, 5), round(r.difference, 5)) for r in df.collect())


def test_losses_are_those_of_plain_counting(spark, corpus):
    docs, target = table(spark, corpus), spark.createDataFrame([(i,) for i in range(0, 120, 3)], "doc_id long")
    rows = [tuple(r) for r in cross_entropy.roles(docs, target).collect()]
    by = Counter()
    for i, t, role, _ in rows:
        assert (role != 2) if i is not None and i < 120 and i % 3 == 0 else (role != 1)
        by[role] += len((t or "").encode())
    assert by[1] and by[2]
    assert len({(t, f) for _, t, _, f in rows}) == len({t for _, t, _, _ in rows})  # copies share a fold
    assert losses(cross_entropy.cross_entropy_difference(docs, target)) == plain_losses(rows)


def test_losses_count_every_word_and_bigram_in_many_chunks_and_buckets(spark):
    rng = random.Random(3)
    n = 21_000  # each word stands in a text of the target and in one of the rest
    names = [f"v{k}" for k in range(n)]
    rows = []
    for half in (0, 1):
        rng.shuffle(names)
        rows += [(2 * k + half, " ".join(names[k * 30: k * 30 + 30]), "s") for k in range(n // 30)]
    docs, target = table(spark, rows), spark.createDataFrame([(2 * k,) for k in range(n // 30)], "doc_id long")
    want = plain_losses([tuple(r) for r in cross_entropy.roles(docs, target).collect()])
    assert losses(cross_entropy.cross_entropy_difference(docs, target)) == want
    assert losses(cross_entropy.cross_entropy_difference(docs, target, size=40_000, bucket=1000)) == want


def test_a_chunk_sends_its_keys_once_and_small_marks_have_the_plan_of_large_ones(spark):
    docs, target = table(spark, [(i, f"a b{i} c d", "s") for i in range(40)]), spark.createDataFrame([(2 * i,) for i in range(20)], "doc_id long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    roles = cross_entropy.roles(docs, target)
    assert "SortMergeJoin" in plan(roles) and "Broadcast" not in plan(roles)
    sent = plan(cross_entropy.looked_up(cross_entropy.chunks(roles), 1))
    assert sent.count("Scan parquet") == 1 and "Union" not in sent


def test_ids_come_back_as_the_tokenizer_gives_them(spark, corpus):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = token_orc.token_table(table(spark, corpus), path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in corpus), key=lambda i: (i is not None, i or 0))
    want, start = Counter((i, len(x := [*plain.encode(t or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in corpus), 0
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_tokens_of_given_ids_are_looked_up_by_index(spark, tmp_path):
    import public_tokenizers
    from pyarrow import orc
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(vocabulary)
    rows = [(i, f"text number {i} here", "s") for i in range(0, 24_000, 2)] + [(7, "twice", "s"), (7, "again", "s"), (None, "no id", "s")]
    token_orc.write(table(spark, rows), str(tmp_path / "t"), vocabulary, 1)
    got = token_orc.read(spark, str(tmp_path / "t"), [7, 5000, 5001])
    assert "In(doc_id" in got._jdf.queryExecution().executedPlan().toString()  # pushed to the row index and the Bloom filter
    text = {(i, t) for i, t, _ in rows if i in (7, 5000)}
    assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == sorted((i, [*plain.encode(t, add_special_tokens=False).ids, 1]) for i, t in text)
    files = sorted((tmp_path / "t").glob("*.orc"))
    spans = [(min(v), max(v)) for v in ([x for x in orc.ORCFile(f).read(["doc_id"]).column(0).to_pylist() if x is not None] for f in files) if v]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and len(spans) > 1  # files hold ranges of ids
    none = token_orc.token_table(table(spark, []), vocabulary)
    assert none.count() == 0 and token_orc.read(spark, str(tmp_path / "t"), []).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "Some  words, and\nmore. x,y", "s"), (2, None, "s"), (3, "é ü " * 30, "s")]
    for name, whole in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = public_tokenizers.path(name)
        assert token_orc.encoder(path).whole is whole
        plain = Tokenizer.from_file(path)
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_orc.token_table(table(spark, rows), path).collect()}
        assert got == {i: (len(x := [*plain.encode(t or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in rows}


def test_shortages_go_to_siblings_before_ancestors():
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixing.allocate(supply, {}, 100, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.allocate(supply, {}, 200, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    assert mixing.allocate({}, {}, 100, 1) == {}


def test_tables_are_allocated_like_small_trees(spark):
    rng = random.Random(6)
    for turn in range(3):
        supply = {(f"d{rng.randrange(3)}", rng.choice(["en", None, "de"]), f"s{k}"): rng.randrange(0, 300) for k in range(30)}
        weights = {("d0",): 3, ("d1",): 0 if turn == 2 else 1.5, ("d0", "en"): 4, ("d2", None): 2}
        leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()], "a string, b string, c string, t long")
        for budget, epochs in ((1000, 1), (0.5, 1), (4000, 2), (10**6, 2)):
            want = mixing.allocate(supply, weights, int(budget * sum(supply.values())) if isinstance(budget, float) else budget, epochs)
            got = {(r.a, r.b, r.c): r.given for r in mixing.allocated(leaves, ["a", "b", "c"], weights, budget, epochs).collect()}
            assert all(abs(got[k] - want.get(k, 0)) <= 1 for k in supply), turn


def test_a_leaf_gives_a_prefix_of_its_seeded_order(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 4)  # many bins
    levels, budget = mixing.by_source(), 0.7
    for epochs in (1, 2):
        rows = mixing.mix(table(spark, corpus), levels, {("domain1",): 5}, budget, epochs=epochs).collect()
        tie = {r.text: r.h for r in table(spark, corpus).selectExpr("text", "xxhash64(text) as h").distinct().collect()}
        number = lambda s: re.search("([0-9]{1,9})$", s or "")
        leaf = lambda s: ("none" if not number(s) else f"domain{int(number(s)[1]) % 4}", "en", s)
        supply = Counter()
        for _, t, s in corpus:
            supply[leaf(s)] += len(words(t))
        given = mixing.allocate(dict(supply), {("domain1",): 5}, int(budget * supply.total()), epochs)
        want = Counter()
        for of, tokens in given.items():
            whole, mark, run = tokens // supply[of], tokens % supply[of], 0
            mine = [(i, t) for i, t, s in corpus if leaf(s) == of]
            name = lambda x: hashlib.md5(f"11|{whole}|{'null' if x[0] is None else x[0]}|{tie[x[1]]}".encode()).hexdigest()  # noqa: E731, B023
            for i, t in sorted(mine, key=name):
                times = whole + (run < mark)
                run += len(words(t))
                if times:
                    want[i, len(words(t)), times] += 1
        assert Counter((r.doc_id, r.tokens, r.times) for r in rows) == want
    drawn = mixing.mixed(table(spark, corpus), levels, {("domain1",): 5}, budget, epochs=2)
    assert drawn.columns == [c.split()[0] for c in CLASH.split(", ")]
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({i: n for i, n in sum((Counter({r.doc_id: r.times}) for r in rows), Counter()).items()})


def test_half_of_the_rows_may_have_one_key(spark):
    rows = [(None if k % 2 else k, "the same text", "s") for k in range(4000)]
    got = sharding.shard_by_bytes(table(spark, rows), 5, range_rows=50).collect()
    assert len(got) == 4000 and max(Counter(r.range_id for r in got).values()) < 400
    assert set(Counter(r.shard for r in got).values()) == {800}
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(800))


def test_one_kind_of_label_teaches_nothing(spark):
    docs = table(spark, [(i, f"word{i} text", "s") for i in range(60)])
    for labels in ([(i, 0) for i in range(60)], [(i, int(i > 52)) for i in range(60)], [(i, y) for i in range(60) for y in (0, 1)]):
        scores = {r.score for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
        assert scores == {0.0}


def test_the_standard_header_is_known_whole(spark):
    header = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    marks = ["", "# ", "// ", " * ", "-- "]
    rows = [(k, "\n".join((m + x).rstrip() for x in header.split("\n")), "s") for k, m in enumerate(marks)]
    for r in licences.scan(table(spark, rows)).collect():
        assert (r.licences, r.n_unknown, r.n_known) == ("Apache-2.0", 0, 6), r


def test_licences_by_their_sentences(spark):
    full = "\n".join(licences.SENTENCES[k][0] for k in ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    rows = [(1, "Some words.\nReleased under the MIT License.", "s"), (2, full, "s"), (3, "no end\nLicensed under CC BY-NC 4.0.", "s"), (4, "Licensed under the Secret License.", "s"), (5, None, "s"), (6, "", "s"), (7, "plain words " * 500, "s"), (None, "# Licensed under the Apache License,\n# Version 2.0.", "s")]
    got = {r.doc_id: (r.licences, r.n_known, r.n_unknown) for r in licences.scan(table(spark, rows)).collect()}
    assert got[1] == ("MIT", 1, 0) and got[2] == ("MIT", 5, 0) and got[3] == ("CC-BY-NC-4.0", 1, 0) and got[4] == ("", 0, 1)
    assert got[5] == got[6] == got[7] == ("", 0, 0) and got[None] == ("Apache-2.0", 1, 0)


def test_every_licence_sentence_and_rule_is_found(spark):
    wrap = lambda t: "# a tool\n#\n" + "\n".join("# " + x for x in textwrap.wrap(t, 60))
    cases = [(t, name, None) for name, texts in licences.SENTENCES.items() for t in texts]
    cases += [("\n".join(licences.SENTENCES[i][0] for i in run), ",".join(run), name) for name, run in licences.RULES]
    cases += [(" ".join(licences.SENTENCES[i][0] for i in run), ",".join(run), name) for name, run in licences.RULES if "gpl" in run[0]]
    cases += [("Copyright A B\n\n" + wrap(licences.SENTENCES[i][0])[12:], i, name) for i, name in (("gpl3-later", "GPL-3.0-or-later"), ("gpl2-later", "GPL-2.0-or-later"), ("lgpl-later", "LGPL-2.1-or-later"), ("mpl-ref", "MPL-2.0"))]
    cases += [("Not so: " + licences.SENTENCES["mpl-ref"][0][5:], "unknown", "")]  # not from its beginning
    got = {r.doc_id: r for r in licences.scan(table(spark, [(k, c[0], "s") for k, c in enumerate(cases)])).collect()}
    assert [(k, got[k].sentences) for k in got] == [(k, cases[k][1]) for k in got]
    assert [(k, got[k].licences) for k in got if cases[k][2] is not None] == [(k, cases[k][2]) for k in got if cases[k][2] is not None]


def test_empty_tables(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for made in (line_rules.line_rules(none), line_rules.clean(none), sharding.shard_by_bytes(none, 4), toxicity.toxicity(none, labels), decontaminate.leaks(none, bench),
                 decontaminate.decontaminated(none, bench), mixing.mix(none, mixing.by_source(), {}, 0.5), cross_entropy.cross_entropy_difference(none, labels), licences.scan(none)):
        assert made.count() == 0
