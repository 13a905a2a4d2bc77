"""Canonical tables of timed interactions, projected from the generated `events` table.

Times are microseconds since 1970 as BIGINT, so that intervals are plain integers; missing columns of
a fixed schema are added as null and others dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000
SCHEMAS = {
    "dyads": "event_id long, source_id long, target_id long, start long, end long, weight double, kind string, directed boolean",
    "groups": "group_id string, start long, end long, location string",
    "memberships": "group_id string, node_id long, weight double",
}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(zero)


def enforced(df: DataFrame, name: str) -> DataFrame:
    """The columns of a canonical table in their order and types."""
    fields = [p.strip().split(" ") for p in SCHEMAS[name].split(",")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair events of a user and another; they last `value` minutes."""
    e = events(spark, sf_dir)
    start = micros(F.col("ts"))
    return enforced(e.select(
        "event_id", F.col("user_id").alias("source_id"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("target_id"),
        start.alias("start"), (start + F.round(F.col("value") * 60_000_000).cast("long")).alias("end"),
        F.col("value").alias("weight"), F.col("event_type").alias("kind"), (F.col("event_type") == "purchase").alias("directed")), "dyads")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen at the same kind of event in the same hour: (group_id, node_id, start, kind)."""
    hour = (micros(F.col("ts")) / HOUR).cast("long")
    return events(spark, sf_dir).select(
        F.concat_ws(":", "event_type", hour.cast("string")).alias("group_id"), F.col("user_id").alias("node_id"), (hour * HOUR).alias("start"), F.col("event_type").alias("kind")).distinct()


#: The same tables in SQL.
SQL = """
dyads AS (
  SELECT event_id, user_id AS source_id, (user_id * 7 + event_id) % 150 AS target_id, epoch_us(ts) AS start,
         epoch_us(ts) + round(value * 60000000)::BIGINT AS "end", value AS weight, event_type AS kind, event_type = 'purchase' AS directed FROM events),
memberships AS (
  SELECT DISTINCT event_type || ':' || (epoch_us(ts) // 3600000000) AS group_id, user_id AS node_id,
         epoch_us(ts) // 3600000000 * 3600000000 AS start, event_type AS kind FROM events)"""
