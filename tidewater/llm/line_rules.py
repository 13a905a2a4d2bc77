"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, single spaces) and hashed together with their host. A line that
stands in at least `min_docs` distinct documents of a host is boilerplate of that host if those are
more than `max_share` per cent of them, or `enough` documents whatever their share: in a host that
holds a third of all rows no share would be reached. A document counts a line once, however often it
repeats it. With `per_text` equal texts count as one document, so that a copied document doesn't turn
its own lines into boilerplate. A document that loses more than `max_removed` per cent of its words is
depleted.

Defined cases: a null text counts as an empty one (no words: it fails the base rules); null hosts
are one host; ids may be null or repeat, since rows are told apart by id, host and text, and equal
rows get equal results; an empty table gives an empty result; columns besides id, text and host are
carried by `clean` and not read otherwise, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Production limits; shares are per cent."""

    min_docs: int = 10
    max_share: int = 5
    enough: int = 10_000
    per_text: bool = False
    max_removed: int = 70
    min_words: int = 10
    max_repeat: int = 20


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), f"[{SPACE}]+", " "))


def _line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, _normal(line))


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit("host"), F.col(host_col)).alias("host"),
        F.xxhash64(text).alias("content")).withColumn("row", _row(F.col("doc_id"), F.col("host"), F.col("content")))


def _row(key: Column, host: Column, content: Column) -> Column:
    """What rows are told apart by: the id, and a hash of all three."""
    return F.struct(F.coalesce(key, F.lit(-(1 << 62))).alias("id"), F.xxhash64(key, host, content).alias("hash"))


def base_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds the figures of each text's own words and lines to (doc_id, text, ...)."""
    x = docs.withColumn("w", words(F.col("text"))).withColumn("h", F.transform("w", lambda v: F.xxhash64(v)))
    n = F.size("h")
    x = x.withColumn("win", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>")))
    # windows that are found again are neighbours once sorted
    x = x.withColumn("s", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).otherwise(F.array().cast("array<struct<v:bigint,i:int>>")))
    x = x.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda e, i: (F.get("s", i - 1)["v"] == e["v"]) | (F.get("s", i + 1)["v"] == e["v"])), lambda e: e["i"])))
    m = F.size("p")  # 0, or at least 2
    gaps = F.aggregate(F.sequence(F.lit(0), m - 2), F.lit(5), lambda a, i: a + F.least(F.lit(5), F.get("p", i + 1) - F.get("p", i)))
    x = x.withColumn("n_repeat_words", F.when(m == 0, 0).otherwise(gaps).cast("long"))
    solid = F.filter(F.split("text", "\n"), lambda v: v.rlike(f"[^{SPACE}]"))
    x = x.withColumn("lines", solid)
    x = x.withColumns({
        "n_words": F.size("w").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat)
    return x.withColumn("base_failed", failed).drop("w", "h", "win", "s", "p", "lines")


def _lines(keyed: DataFrame) -> DataFrame:
    line = F.explode(F.filter(F.split("text", "\n"), lambda v: v.rlike(f"[^{SPACE}]"))).alias("line")
    return keyed.select("row", "host", line).select("row", _line_key(F.col("host"), F.col("line")).alias("key"), F.size(words(F.col("line"))).alias("n"))


def boilerplate(keyed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(key, n_docs): the lines above the limits of their host."""
    lines = F.filter(F.split("text", "\n"), lambda v: v.rlike(f"[^{SPACE}]"))
    host = F.col("host")
    once = F.explode(F.array_distinct(F.transform(lines, lambda v: _line_key(host, v)))).alias("key")
    docs = keyed.select("host", "content").distinct() if limits.per_text else keyed
    of_host = docs.groupBy("host").agg(F.count("*").alias("host_docs"))
    seen = keyed.select("host", "content", once)
    seen = (seen.distinct() if limits.per_text else seen).groupBy("host", "key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= limits.min_docs)
    return seen.join(of_host, "host").where((F.col("n_docs") >= limits.enough) | (F.col("n_docs") * 100 > F.col("host_docs") * limits.max_share)).select("key", "n_docs")


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row for each row of `docs`: base figures, words on boilerplate lines and the verdict."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    lost = _lines(keyed).join(boilerplate(keyed, limits).select("key"), "key").groupBy("row").agg(F.sum("n").alias("removed"), F.count("*").alias("lines"))
    # rows that repeat as a whole share a key: each has its share of the sums
    same = keyed.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")
    lost = lost.join(same, "row", "left").select("row", (F.col("removed") / F.coalesce("copies", F.lit(1))).cast("long").alias("removed"), (F.col("lines") / F.coalesce("copies", F.lit(1))).cast("long").alias("lines"))
    x = base_rules(keyed, limits).drop("text", "host", "content").join(lost, "row", "left")
    x = x.withColumns({"n_removed_lines": F.coalesce("lines", F.lit(0)).cast("long"), "n_removed_words": F.coalesce("removed", F.lit(0)).cast("long")})
    kept = ~F.col("base_failed") & (F.col("n_removed_words") * 100 <= F.col("n_words") * limits.max_removed)
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_removed_lines", "n_removed_words")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with their columns; boilerplate lines are gone from their texts.

    Rows that fail by their own text go before the join, which moves each of the others once.
    """
    keyed = _keyed(docs, id_col, text_col, host_col)
    lost = _lines(keyed).join(boilerplate(keyed, limits).select("key"), "key").groupBy("row").agg(F.collect_set("key").alias("gone"))
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    text, host = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")), F.xxhash64(F.lit("host"), F.col(f"doc.`{host_col}`"))
    every = every.withColumns({"text": text, "row": _row(F.col(f"doc.`{id_col}`").cast("long"), host, F.xxhash64(text))})
    # the filter stays above this projection: below it, each figure would be worked out many times over
    every = base_rules(every, limits).withColumn("place", F.monotonically_increasing_id()).where((F.col("place") >= 0) & ~F.col("base_failed")).select("doc", "row", "n_words")
    x = every.join(lost, "row", "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda v: ~F.array_contains("gone", _line_key(host, v))), "\n")
    x = x.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    x = x.withColumns({"remain": F.when(F.col("gone").isNotNull(), F.size(words(F.col("left")))).otherwise(F.col("n_words")), "place": F.monotonically_increasing_id()})
    x = x.where((F.col("place") >= 0) & ((F.col("n_words") - F.col("remain")) * 100 <= F.col("n_words") * limits.max_removed))
    new = {text_col: F.coalesce("left", F.col(f"doc.`{text_col}`"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("doc.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return x.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
