"""Delimited text files as canonical tables: what a file's columns mean is declared, and Spark splits and reads the files.

A layout names the columns of a file with their types and gives each canonical column as an expression over them. Lines that
don't fit are kept apart with their text, so a file's rows are always the mapped ones and the rejected ones together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.contract import node_id
from tidewater.sources.dataset import Dataset, individuals_from, table, windows_from_groups, windows_from_pairs, with_bounds

_LINE = "_line"


@dataclass(frozen=True)
class Layout:
    """Columns of a file in their order ("name type, ..."), what it maps to, and how it is written.

    `maps` are SQL expressions by canonical column; `required` are canonical columns that a row can't lack.
    """

    columns: str
    maps: dict[str, str]
    required: tuple[str, ...] = ()
    separator: str = ","
    header: bool = True
    null: str = ""
    options: dict[str, str] = field(default_factory=dict)


def micros_of_text(text: Column, form: str) -> Column:
    """Microseconds since 1970 of a local time such as 240131235959 by its form, null where it isn't one."""
    at = F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, at)


def lines(spark: SparkSession, path: str | list[str], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the columns of the layout, and (line) of what doesn't fit their types or their number.

    Values are read as they stand and cast here, so that a broken one is seen whichever columns are asked for later.
    """
    fields = [c.strip().split(" ", 1) for c in layout.columns.split(",")]
    schema = ", ".join([*(f"`{n}` string" for n, _ in fields), f"{_LINE} string"])
    every = spark.read.schema(schema).options(
        sep=layout.separator, header=layout.header, nullValue=layout.null, mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE, columnPruning=False, **layout.options).csv(path)
    fits = F.col(_LINE).isNull()
    for n, t in fields:
        fits = fits & (F.col(n).isNull() | F.col(n).try_cast(t).isNotNull())
    line = F.coalesce(_LINE, F.concat_ws(layout.separator, *(F.coalesce(n, F.lit(layout.null)) for n, _ in fields)))
    return every.where(fits).select(*(F.col(n).try_cast(t).alias(n) for n, t in fields)), every.where(~fits).select(line.alias("line"))


def _mapped(spark: SparkSession, path: str | list[str], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(mapped columns, rejects); rows without a required value are rejected too, with their values written again."""
    good, bad = lines(spark, path, layout)
    made = good.select(F.struct(*good.columns).alias("_row"), *good.columns)
    made = made.select("_row", *(F.expr(e).alias(c) for c, e in layout.maps.items()))
    lacks = F.lit(False)
    for c in layout.required:
        lacks = lacks | F.col(c).isNull()
    again = F.concat_ws(layout.separator, *(F.coalesce(F.col(f"_row.{c}").cast("string"), F.lit(layout.null)) for c in good.columns))
    return made.where(~lacks).drop("_row"), bad.union(made.where(lacks).select(again))


def mapped(spark: SparkSession, path: str | list[str], layout: Layout, name: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """(table, rejects) of a canonical table."""
    made, rejects = _mapped(spark, path, layout)
    return table(made.withColumn("dataset_id", F.lit(dataset_id)), name), rejects


def pair_dataset(spark: SparkSession, dataset_id: str, path: str | list[str], layout: Layout, ordered: bool = True, roster: DataFrame | None = None) -> tuple[Dataset, DataFrame]:
    """(dataset, rejects) of files of pair events: undirected ends come in the order of their names, individuals have bounds."""
    pairs, rejects = mapped(spark, path, layout, "dyadic_events", dataset_id)
    named = pairs.withColumns({"source_id": node_id(F.col("source_id")), "target_id": node_id(F.col("target_id")), "directed": F.coalesce("directed", F.lit(False))})
    turn = ~F.col("directed") & (F.col("source_id") > F.col("target_id"))
    pairs = named.withColumns({"source_id": F.when(turn, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(turn, F.col("source_id")).otherwise(F.col("target_id"))})
    ds = Dataset(spark, dataset_id, {"dyadic_events": pairs}, ordered)
    windows = windows_from_pairs(ds)
    return Dataset(spark, dataset_id, {**ds.tables, "individuals": with_bounds(individuals_from(ds, roster), windows), "observation_windows": windows}, ordered), rejects


def group_dataset(spark: SparkSession, dataset_id: str, path: str | list[str], layout: Layout, group: list[str], ordered: bool = True) -> tuple[Dataset, DataFrame]:
    """(dataset, rejects) of files with a row for each member of a group; `group` are the columns that tell and describe a group.

    A group's members are those of all of its rows, once each; of what a group's rows say of it, the least values are taken. The
    layout requires group_event_id and node_id.
    """
    made, rejects = _mapped(spark, path, layout)
    made = made.withColumn("node_id", node_id(F.col("node_id")))
    rest = [c for c in group if c != "group_event_id"]
    groups = made.groupBy("group_event_id").agg(*(F.min(c).alias(c) for c in rest))
    members = made.select("group_event_id", "node_id").distinct().withColumn("membership_weight", F.lit(1.0))
    ds = Dataset(spark, dataset_id, {"group_events": groups, "group_memberships": members}, ordered)
    windows = windows_from_groups(ds)
    return Dataset(spark, dataset_id, {**ds.tables, "individuals": with_bounds(individuals_from(ds), windows), "observation_windows": windows}, ordered), rejects
