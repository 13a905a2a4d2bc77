"""Main texts of pages, without what the templates of their sites repeat.

Each task reads its pages once for the counts: the subtree of every block element is hashed (tags and
texts, not attributes), and Spark counts for each host and hash the pages with distinct contents that
have it. A subtree that stands in at least `min_pages` of them is template of the host if those are
`share` per cent of the host's pages, or `enough` pages whatever their share; paragraphs, headings,
lists and tables outside of an article need the share. Template subtrees are deleted from every page of the
host, whatever they hold. What no count can tell, since a host has few pages or an advert stands on
one only, is told by element (`nav`, `footer`, `aside`, `form` ...), role, class or id; and a page
that marks its main part or its articles has its text there.

Copies don't make templates: pages with the same text count once, what an article is written in
(paragraphs, headings, lists, tables inside of it) is never template, nor is a subtree that holds a
block of 50 words or more outside of links. So passages that many pages of a host share stay.

No key meets in one task: at most HOT (host, hash) keys hold a HOT-th of all subtrees each, and those are
broadcast; all other keys are small beside the rest. A page's own subtrees come together, never a host's.

Defined cases: null or empty html gives an empty text; pages without a host (null or odd URLs) have no
templates, and are told by elements and names; rows that repeat are each returned, and count once; ids
may be null; unclosed tags, comments and attributes end where HTML has them end; an empty table gives an
empty result; other columns than the three named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Steps, ship
from tidewater.llm.html_tree import page
from tidewater.llm.url_list import host_of

#: Keys that may be broadcast; a key with less than a HOT-th of the rows goes through a shuffle.
HOT = 4096


@dataclass(frozen=True)
class Limits:
    """When a subtree is template; the share is per cent."""

    min_pages: int = 5
    share: int = 10
    enough: int = 50


_ELEMENT = "struct<hash: bigint, first: int, last: int, share: boolean>"


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str, texts: bool) -> DataFrame:
    """(page, row, url, host, blocks, elements, content) of each page; without `texts`, blocks are left empty."""
    plain = pages.select(
        F.col(id_col).cast("long").alias("page"), F.xxhash64(F.col(id_col).cast("long"), url_col, html_col).alias("row"),
        F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    names = ("hash", "first", "last", "share")

    def listed(lists: list[list], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # the texts of some pages at a time
                some = batch.slice(k, 64)
                read = [page(v or "") for v in some.column(4).to_pylist()]
                blocks, elements = [p.blocks if texts else [] for p in read], [p.elements for p in read]
                of = list(zip(*(e for p in elements for e in p), strict=True)) or [()] * 4
                of = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(of, kinds, strict=True)], names)
                yield pa.record_batch([
                    *(some.column(c) for c in range(4)), listed(blocks, pa.array([b for p in blocks for b in p], pa.string())), listed(elements, of),
                    pa.array([p.content for p in read], pa.int64())], ["page", "row", "url", "host", "blocks", "elements", "content"])

    return plain.mapInArrow(rows, f"page long, row long, url string, host string, blocks array<string>, elements array<{_ELEMENT}>, content long")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limits: Limits = Limits()) -> DataFrame:
    """(id, url, text, n_chars, n_template) of every page; n_template counts the page's elements that are template of its host."""
    spark = pages.sparkSession
    ship(spark)
    steps = Steps(spark)
    seen = _parsed(pages, id_col, url_col, html_col, False).where("host <> ''")
    # a subtree that recurs inside a page is asked for once
    once = F.array_distinct(F.transform("elements", lambda e: F.struct(F.xxhash64("host", e["hash"]).alias("key"), e["share"].alias("share"))))
    seen = steps.cut(seen.select("page", "row", "host", "content", once.alias("keys")), "templates-seen")
    of_host = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of_host"))
    found = seen.select("host", "content", F.explode("keys").alias("k")).select("host", "content", "k.key", "k.share").distinct()
    found = found.groupBy("host", "key", "share").agg(F.count("*").alias("n")).where(F.col("n") >= limits.min_pages).join(of_host, "host")
    found = found.where((F.col("n") * 100 >= F.col("of_host") * limits.share) | ~F.col("share") & (F.col("n") >= limits.enough))
    found = steps.cut(found.groupBy("key").agg(F.sum("n").alias("n")), "templates-found")
    asked = seen.select("page", "row", F.explode("keys.key").alias("key"))
    total = seen.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    # pages that count once may still be many rows: what is hot is told by rows
    often = asked.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") * HOT > total)
    hot = F.broadcast(often.select("key", F.lit(True).alias("hot")))  # at most HOT rows
    known = F.broadcast(found.join(often, "key", "left_semi").select("key", F.lit(True).alias("template")))  # at most HOT rows
    told = asked.join(hot, "key", "left").join(known, "key", "left")
    gone = told.where("template").select("page", "row", "key").union(told.where("hot is null").select("page", "row", "key").join(found.select("key"), "key", "left_semi").select("page", "row", "key"))
    gone = gone.groupBy(F.coalesce("page", F.lit(-(1 << 62))).alias("id"), "row").agg(F.collect_set("key").alias("gone"))
    every = _parsed(pages, id_col, url_col, html_col, True).withColumn("id", F.coalesce("page", F.lit(-(1 << 62))))
    x = every.join(gone, ["id", "row"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    x = x.withColumn("out", F.filter("elements", lambda e: F.array_contains("gone", F.xxhash64("host", e["hash"]))))
    x = x.withColumn("cuts", F.filter("out", lambda e: e["first"] < e["last"]))
    left = F.filter("blocks", lambda b, i: ~F.exists("cuts", lambda e: (e["first"] <= i) & (i < e["last"])))
    x = x.withColumn("text", F.array_join(F.when(F.size("cuts") == 0, F.col("blocks")).otherwise(left), "\n\n"))
    return x.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), F.size("out").cast("long").alias("n_template"))
