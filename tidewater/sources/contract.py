"""The canonical contract: node names, individuals, exposure streams and their checks, and bundles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.canonical import SCHEMAS, enforced

STREAM = ["event_id", "source_id", "target_id", "start", "end", "multiplier", "mapper"]


def node_id(value: Column) -> Column:
    """A node's name: trimmed, without ".0" at the end, empty for null; whole numbers keep all of their digits."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    whole = value.cast("double").cast("decimal(38,0)").cast("string")  # doubles from 10 ** 7 on are written with an exponent
    return F.when(text.rlike(r"^-?[0-9][.][0-9]+E[0-9]+$"), whole).otherwise(F.regexp_replace(text, r"\.0$", ""))


def canonical_pair(source: Column, target: Column) -> tuple[Column, Column]:
    """The ends of an undirected pair in the order of their names; with a null end they stay as they are."""
    known = source.isNotNull() & target.isNotNull()
    return F.when(known, F.least(source, target)).otherwise(source), F.when(known, F.greatest(source, target)).otherwise(target)


def observed(ends: DataFrame, node: str) -> DataFrame:
    """(node, first_seen, last_seen, n) of every name that isn't empty."""
    return ends.where(F.col(node) != "").groupBy(node).agg(F.min("start").alias("first_seen"), F.max("end").alias("last_seen"), F.count("*").alias("n"))


def exposures(dyads: DataFrame, mapper: str, multiplier: Column) -> DataFrame:
    """An exposure stream: rows of positive length between two nodes, without those flagged as exact duplicates."""
    some = dyads.where((F.col("end") > F.col("start")) & (F.col("source_id") != F.col("target_id")))
    if "quality_flag" in dyads.columns:
        some = some.where(~F.contains(F.coalesce("quality_flag", F.lit("")), F.lit("exact_duplicate_source_record")))
    return some.select("event_id", "source_id", "target_id", "start", "end", multiplier.cast("double").alias("multiplier"), F.lit(mapper).alias("mapper"))


def combined(*streams: DataFrame) -> DataFrame:
    """All rows of several streams."""
    out = streams[0].select(*STREAM)
    for s in streams[1:]:
        out = out.unionByName(s.select(*STREAM))
    return out


def stream_issues(dyads: DataFrame, memberships: DataFrame, individuals: DataFrame) -> DataFrame:
    """(code, n) of each check of a stream against its groups and its roster (node)."""
    bad = dyads.agg(
        F.count_if((F.col("end") <= F.col("start")) | F.col("start").isNull() | F.col("end").isNull()).alias("bad_interval"),
        F.count_if((F.col("weight") < 0) | F.col("weight").isNull()).alias("bad_multiplier"))
    rows = bad.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in bad.columns))).alias("x")).select("x.*")
    nodes = dyads.select(F.explode(F.array("source_id", "target_id")).alias("node")).where("node is not null").distinct()
    count = lambda df, code: df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    again = memberships.groupBy("group_id", "node_id").count().where("count > 1")
    small = memberships.groupBy("group_id").count().where("count < 2")
    return rows.union(count(nodes.join(individuals, "node", "left_anti"), "orphan_nodes")).union(count(again, "duplicate_members")).union(count(small, "small_groups"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Write the canonical tables as Parquet under one folder; all columns of a schema are there, in its order."""
    for name, df in tables.items():
        enforced(df, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a bundle by name."""
    return {n: spark.read.schema(SCHEMAS[n].replace(" end ", " `end` ")).parquet(f"{path}/{n}") for n in names or SCHEMAS}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A canonical table without rows."""
    return spark.createDataFrame([], SCHEMAS[name])
