"""How far the sources of a language stand apart in their words: an audit in a three-dimensional cube.

A language keeps the terms that stand in at least `min_docs` of its rows. Each source has a smoothed
share of each kept term, in whole numbers: p = 1 + (10 ** 9 * (count + 5)) div (N + 5 * V), with N its terms
and V the kept ones. The divergence of two sources is the sum of |p - q| over all kept terms.

Sources are dealt into blocks of GROUPS and terms into blocks of TERMS. A task owns cells (block of
sources, block of sources, block of terms): it gets the slices of both blocks, fills them up with the
shares of terms that a source doesn't have, and gives the part of the divergence of each two of its
sources; the parts are then added up along the terms. A slice goes to as many cells as there are
blocks of sources, and a cell holds two slices of at most GROUPS * TERMS numbers, whatever the
input. Counts are taken in the tasks that read the texts, a bounded table at a time, and meet in one
shuffle by language and term, where a language's document count of a term is a sum over neighbours.

Small tables of languages and sources are broadcast only where Spark finds their files below
spark.sql.autoBroadcastJoinThreshold; else they are joined by shuffles.

Defined cases: null text, language and source are empty ones; a source without terms has N = 0 and
is compared like the others; a language without kept terms has divergences of 0; one of a single source has
no pairs; rows that repeat are counted each; an empty table gives an empty result; only the three
named columns are read, whatever others are called.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import Steps, cut, ship

GROUPS, TERMS = 128, 4096
#: Entries that a reading task holds before it hands them on.
HELD = 400_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows, added up as far as a task holds them."""

    def made(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, rows) in held.items():
            size = len(n)
            if size:
                yield pa.record_batch([
                    pa.array([lang] * size), pa.array([source] * size), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                    pa.array([rows[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                found = _TERM.findall(text.as_buffer().to_pybytes().lower())
                n, docs_of = held[(lang, source)]
                before = len(n)
                n.update(found)
                docs_of.update(set(found))
                size += len(n) - before
                if size > HELD:
                    yield from made(held)
                    held.clear()
                    size = 0
        yield from made(held)

    return docs.mapInArrow(rows, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str) -> F.Column:
    """The smoothed share, exact at any count."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * (cast({n} as decimal(18,0)) + 5)) div (cast({total} as decimal(18,0)) + 5 * cast(v as decimal(16,0)))")


def _cell(table: pa.Table) -> pa.Table:
    """The parts of the divergences of one cell; rows with t < 0 tell a source, its share of absent terms and the terms of the block."""
    lang, at, bi, bj = (table.column(k)[0].as_py() for k in ("lang", "tb", "bi", "bj"))
    role, g, t, p, width = (table.column(k).to_numpy() for k in ("role", "g", "t", "p", "width"))
    sides = []
    for side in (0, 1):
        head = (role == side) & (t < 0)
        ids, rest = np.sort(g[head]), p[head][np.argsort(g[head])]
        dense = np.repeat(rest[:, None], int(width.max(initial=0)), axis=1)
        some = (role == side) & (t >= 0)
        dense[np.searchsorted(ids, g[some]), t[some]] = p[some]
        sides.append((ids, dense))
    (a, x), (b, y) = sides
    part = [np.abs(y - one).sum(axis=1) for one in x]
    i, j, part = np.repeat(a, len(b)), np.tile(b, len(a)), np.concatenate([np.zeros(0, np.int64), *part])  # a block may be empty
    keep = (i < j) | (bi != bj)
    n = int(keep.sum())
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "bi": pa.array([bi] * n, pa.int32()), "i": i[keep], "bj": pa.array([bj] * n, pa.int32()), "j": j[keep], "part": part[keep]})


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distances to the others, and the terms it has more of than its language."""
    spark = docs.sparkSession
    ship(spark)
    steps = Steps(spark)
    given = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = _counts(given).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = F.sum("docs").over(Window.partitionBy("lang", "term"))
    counts = steps.cut(counts.withColumn("in_lang", of_term).where(F.col("in_lang") >= min_docs).select("lang", "term", "source", "n"), "divergence-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"))
    sources = given.select("lang", "source").distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    sizes = sources.groupBy("lang").agg(F.count("*").alias("sources")).join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all")), "lang", "left")
    some = lambda c: F.coalesce(c, F.lit(0))
    sizes = steps.cut(sizes.select("lang", some("v").alias("v"), some("all").alias("all"), F.ceil(F.col("sources") / GROUPS).cast("int").alias("g_blocks"), F.greatest(F.lit(1), F.ceil(some("v") / TERMS)).cast("int").alias("t_blocks")), "divergence-sizes")
    place = lambda block, by: (F.row_number().over(Window.partitionBy("lang", block).orderBy(by)) - 1)
    terms = terms.join(sizes, "lang").withColumn("tb", F.pmod(F.xxhash64("term"), F.col("t_blocks").cast("long")).cast("int"))
    terms = steps.cut(terms.select("lang", "term", "tb", place("tb", "term").alias("t"), _share("total", "all").alias("q")), "divergence-terms")
    sources = sources.join(own, ["lang", "source"], "left").join(sizes, "lang").withColumn("own", some("own"))
    sources = sources.withColumn("gb", F.pmod(F.xxhash64("source"), F.col("g_blocks").cast("long")).cast("int"))
    sources = steps.cut(sources.select("lang", "source", "own", "v", "gb", place("gb", "source").alias("g"), "g_blocks", "t_blocks"), "divergence-sources")
    shares = counts.join(terms, ["lang", "term"]).join(sources.drop("t_blocks"), ["lang", "source"]).withColumn("p", _share("n", "own"))
    shares = steps.cut(shares.select("lang", "source", "term", "gb", "g", "g_blocks", "tb", "t", "p", "q"), "divergence-shares")

    width = terms.groupBy("lang", "tb").agg(F.count("*").cast("int").alias("width"))
    absent = F.when(F.col("v") > 0, F.expr("1 + 5000000000 div (own + 5 * v)")).otherwise(0)
    heads = sources.select("lang", "gb", "g", "g_blocks", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("tb"), absent.alias("p")).join(width, ["lang", "tb"], "left")
    heads = heads.select("lang", "gb", "g", "g_blocks", "tb", F.lit(-1).alias("t"), "p", some("width").alias("width"))
    slices = shares.select("lang", "gb", "g", "g_blocks", "tb", "t", "p", F.lit(0).alias("width")).union(heads)
    gb = F.col("gb")
    cells = F.concat(
        F.transform(F.sequence(gb, F.col("g_blocks") - 1), lambda b: F.struct(gb.alias("bi"), b.alias("bj"), F.lit(0).alias("role"))),
        F.transform(F.sequence(F.lit(0), gb), lambda b: F.struct(b.alias("bi"), gb.alias("bj"), F.lit(1).alias("role"))))
    slices = slices.select("lang", "tb", F.explode(cells).alias("c"), "g", "t", "p", "width").select("lang", "tb", "c.bi", "c.bj", "c.role", "g", "t", "p", "width")
    parts = slices.groupBy("lang", "tb", "bi", "bj").applyInArrow(_cell, "lang string, bi int, i int, bj int, j int, part long")
    pairs = parts.groupBy("lang", "bi", "i", "bj", "j").agg(F.sum("part").alias("value"))
    named = sources.select("lang", F.col("gb").alias("bi"), F.col("g").alias("i"), F.col("source").alias("s1"))
    pairs = pairs.join(named, ["lang", "bi", "i"]).join(named.toDF("lang", "bj", "j", "s2"), ["lang", "bj", "j"])
    both = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))).alias("x")
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", ranked("lang", "source"))
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), "tb")
    more = more.withColumn("rank", ranked("lang", "source", "tb")).where(F.col("rank") <= top).drop("tb")  # a hot source's terms first meet by blocks
    more = more.withColumn("rank", ranked("lang", "source")).where(F.col("rank") <= top)
    made = cut(pairs.union(more), "divergence")
    steps.clear()
    return made
