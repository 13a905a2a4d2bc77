"""Lexical search, source divergences and main texts of pages against brute force; nulls, ties, repeats, empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidewater.llm import divergence, lexical, templates
from tidewater.llm.html_tree import page

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {k: k + 32 for k in range(65, 91)}
#: Further columns with names that operators use themselves.
CLASH = "doc_id long, text string, source string, lang string, item int, part string, term string, score long, rank int, n int"


def terms(pattern, text):
    return [t.translate(LOWER) for t in pattern.findall(text or "")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, g, 1, "p", "t", 2, 3, 4) for i, t, s, g in rows], CLASH)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)] + ["Éa", "É", "über", "x1", "ÀB", "Z"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) + rng.choice(["", ".", "!-w1", "\x00w2"]), rng.choice(["s1", "s2", None]), rng.choice(["en", "fr"])) for i in range(150)]
    rows += [(200, None, "s1", "en"), (201, "", "s9", None), (202, " .,! ", "s9", "en"), (None, "w1 w2 w3", "s1", "en"), (7, "w1 w2 w3", "s1", "en"), (7, "w1 w2 w3", "s1", "en"), (203, "w5 " * 40_000 + "w6", "s2", "fr")]
    return rows


def searched(rows, items, top):
    docs_of = [(i, Counter(terms(TERM, t))) for i, t, *_ in rows]
    some = [c for _, c in docs_of if c]
    n, length = len(some), sum(sum(c.values()) for c in some)
    df = Counter(t for c in some for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs_of:
            score = 0
            for t in set(terms(TERM, text)):
                if c[t]:
                    m = 10 + 90 * sum(c.values()) * n // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda v: (v[0], v[1], v[2] or 0))[:top], 1)]
    return out


ITEMS = [(1, "W1 w2, w1 unknown"), (2, "É éa über"), (3, None), (4, "  "), (5, "unknown"), (None, "w7 w8"), (6, "w5 w6"), (1, "W1 w2, w1 unknown"), (8, " ".join(f"w{k}" for k in range(30)))]


@pytest.mark.parametrize("part", [4_000_000, 3])
def test_search_equals_brute_force(spark, corpus, monkeypatch, part):
    monkeypatch.setattr(lexical, "PART", part)  # items in one part, or each in its own
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(docs(spark, corpus).repartition(5), items, top=7)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == Counter(searched(corpus, ITEMS, 7))


def test_search_of_nothing(spark, corpus):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs(spark, corpus).limit(0), items).collect() == []
    assert lexical.search(docs(spark, corpus), items.limit(0)).collect() == []


def diverged(rows, min_docs, top):
    of, rows_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, source, lang in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = terms(LETTERS, text)
        of[key].update(found)
        rows_of[key[0]].update(set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in rows_of[lang].items() if n >= min_docs)
        v = len(kept)
        mine = {s: {t: of[lang, s][t] for t in kept} for g, s in groups if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in mine.items()}
        q = share({t: sum(c[t] for c in mine.values()) for t in kept})
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for name, found, most in (("pair", pairs, None), ("term", more, top)):
                out += [(lang, s, name, i, value, r) for r, (value, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return out


@pytest.mark.parametrize("blocks", [(128, 4096), (2, 3)])
def test_divergences_equal_brute_force(spark, corpus, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "GROUPS", blocks[0])
    monkeypatch.setattr(divergence, "TERMS", blocks[1])
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = [*corpus, *((300 + k, f"w1 only{k} W2", f"t{k % 5}", "en") for k in range(40)), (400, "one", "alone", "xx")]
    got = divergence.divergences(docs(spark, rows).repartition(3), min_docs=12, top=6)
    assert Counter(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == Counter(diverged(rows, 12, 6))


def test_divergences_of_nothing(spark, corpus):
    assert divergence.divergences(docs(spark, corpus).limit(0)).collect() == []
    got = divergence.divergences(docs(spark, [(1, "a", "s", "en"), (2, None, "t", "en")]), min_docs=5).collect()
    assert sorted(tuple(r) for r in got) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_are_exact_at_any_count(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, own long, v long")
    assert df.select(divergence._share("n", "own")).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)


@pytest.mark.parametrize("html, blocks", [
    ("<p>a <span class=ad>buy</span> b<br>c &amp d&nbsp; e</p>x<ul><li>1<li>2</ul><form><p>q</form>", ["a b c & d e", "x", "1", "2"]),
    ("<header><h1>Site</h1></header><main><h1>T</h1><article class='post has-comments'><header><h2>S</h2><p>by</p></header><p>One<p>Two<div class=share>tw</div>"
     "<section class=comments><article class=comment><p>no</p></article></section></article><aside>x</aside></main><footer>f", ["T", "S", "One", "Two"]),
    ("<p>a<!-- x --", ["a"]), ("<p title=\"a>b\">t</p><p data-x=it's>u</p> 1 < 2", ["t", "u", "1 < 2"]), ("<script>var a='</p>';</script><p>ok<script>never", ["ok"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("</div></p><b>y</b>", ["y"]), ("", []), ("<body><p hidden>no</p><div style='display: none'>no</div>yes", ["yes"]),
    ("<form action=/><div><p>" + "word " * 60 + "</p></div></form>", [("word " * 60).strip()]), ("<p>a<style>p{}</style>b<select><option>o</select>", ["ab"])])
def test_blocks_of_a_page(html, blocks):
    assert page(html).blocks == blocks


def test_long_and_deep_pages_take_time_in_proportion():
    assert page("<div>" * 50_000 + "x").blocks == ["x"]
    assert len(page("<ul>" + "<li>a" * 20_000).blocks) == 20_000
    assert len(page("<p>" + "w " * 500_000).blocks[0]) == 999_999
    assert page("</div>" * 20_000 + "<p title=\"" * 2_000).blocks == []


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "b", 1) for r in rows], "page_id long, url string, html string, host string, blocks string, content int")


def test_what_a_site_repeats_goes_and_what_copies_repeat_stays(spark):
    frame = "<div><div>Home of things</div><ul><li><a href=/>Start</a><li><a href=/u{0}>Other</a></ul></div>{1}<div>All rights are ours</div>"
    body = lambda k: f"<div><h2>Title {k}</h2><p>Story number {k} is told here.</p></div>"
    rows = [(k, f"http://a.example/{k}", frame.format(k, body(k))) for k in range(8)]
    rows += [(50 + k, f"https://www.copy.example/{k}", "<p>The same short text.</p><p>And more of it.</p>") for k in range(9)]  # copies count once
    rows += [(70 + k, f"http://b.example/{k}", frame.format(k, body(k))) for k in range(3)]  # too few pages to tell
    rows += [(90, None, "<p>no host</p>"), (91, "http://a.example/x", None), (None, "http://a.example/y", frame.format(9, body(9))), (0, "http://a.example/0", rows[0][2])]
    shared = "<p>" + "passage " * 60 + "</p>"
    rows += [(100 + k, f"http://c.example/{k}", f"<article><h1>Same heading</h1>{shared}<p>Text {k}.</p><div>Share this page</div></article>") for k in range(7)]
    got = templates.main_texts(pages(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "Title 3\n\nStory number 3 is told here." and text[None] == "Title 9\n\nStory number 9 is told here."
    assert text[52] == "The same short text.\n\nAnd more of it." and text[90] == "no host" and text[91] == ""
    assert text[71].startswith("Home of things\n\nStart\n\nOther\n\nTitle 1")
    assert text[104] == "Same heading\n\n" + ("passage " * 60).strip() + "\n\nText 4."
    assert {r["n_template"] for r in got if r["page_id"] == 3} != {0} and sum(r["page_id"] == 0 for r in got) == 2


def test_no_pages(spark):
    got = templates.main_texts(pages(spark, []))
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_template"] and got.collect() == []


def test_hot_subtrees_are_found_beside_rare_ones(spark, monkeypatch):
    monkeypatch.setattr(templates, "HOT", 8)  # keys with more than an eighth of all subtrees go by broadcast, the others through a shuffle
    rows = [(k, "http://a.example/", f"<div>everywhere</div><div>block {k % 3}</div><section><p>text {k} stays</p></section>") for k in range(60)]
    got = templates.main_texts(pages(spark, rows)).collect()
    assert all(r["text"] == f"text {r['page_id']} stays" for r in got)
