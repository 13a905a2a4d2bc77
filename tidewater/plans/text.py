"""Queries that write the generated events as delimited text and read them back as a dataset, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import intervals
from tidewater.operators.turns import Turns
from tidewater.plans.catalogue import DAY, query
from tidewater.sources import canonical, text

PAIR_FILE = text.Layout(
    "record long, left_tag string, right_tag string, began string, seconds double, strength double, flag string",
    {"event_id": "concat('pair:', record)", "source_id": "left_tag", "target_id": "right_tag", "start": "began_at", "end": "began_at + cast(round(seconds * 1000000) as long)", "duration_seconds": "seconds",
     "event_representation": "'interval'", "edge_semantics": "'sensor_proximity'", "measurement_type": "'duration'", "measurement_value": "strength", "measurement_unit": "'second'", "quality_flag": "flag", "source_record_id": "cast(record as string)"},
    ("source_id", "target_id", "start"), separator=";")
#: A local time of a second, without marks.
COMPACT = "yyyyMMddHHmmss"


def _written(spark, df, name):
    turns = Turns(spark)
    path = f"{turns.top}/{name}"
    df.write.option("header", True).option("sep", ";").csv(path)
    return path


def _pair_layout():
    at = f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(try_to_timestamp(began, '{COMPACT}') as timestamp_ntz))"
    maps = {k: v.replace("began_at", at) for k, v in PAIR_FILE.maps.items()}
    return text.Layout(PAIR_FILE.columns, maps, PAIR_FILE.required, PAIR_FILE.separator)


def _pair_file(spark, sf_dir):
    """A file with tags that were read as numbers, odd times and broken values."""
    e = canonical.events(spark, sf_dir)
    i, u = F.col("event_id"), F.col("user_id")
    began = F.when(i % 83 == 0, "not a time").otherwise(F.date_format("ts", COMPACT))
    seconds = F.when(i % 101 == 0, "n/a").otherwise(F.round(F.col("value") * 60, 2).cast("decimal(12,2)").cast("string"))
    rows = e.select(i.alias("record"), F.concat(u.cast("string"), F.lit(".0")).alias("left_tag"), F.when(i % 67 != 0, ((u * 7 + i) % 150).cast("string")).alias("right_tag"), began.alias("began"), seconds.alias("seconds"), F.col("value").alias("strength"), F.when(i % 97 == 0, "exact_duplicate_source_record").alias("flag"))
    return _written(spark, rows, "pairs")


RAW = """r AS (SELECT event_id, user_id::VARCHAR AS a, CASE WHEN event_id % 67 <> 0 THEN ((user_id * 7 + event_id) % 150)::VARCHAR END AS b, CASE WHEN event_id % 83 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS s, round(value * 60, 2)::DECIMAL(12,2)::DOUBLE AS d, value FROM events)"""


@query(f"""WITH {RAW} SELECT 'pair:' || event_id AS event_id, least(a, b) AS source_id, greatest(a, b) AS target_id, s AS start, s + round(d * 1000000)::BIGINT AS "end", d AS duration_seconds, value AS measurement_value
FROM r WHERE event_id % 101 <> 0 AND b IS NOT NULL AND s IS NOT NULL""", tables=False)
def src_text_pairs(spark, sf_dir):
    """SRC-07 to SRC-10, SRC-14, SRC-18, SRC-21: pair events of delimited files by a declared layout."""
    ds, _ = text.pair_dataset(spark, "text", _pair_file(spark, sf_dir), _pair_layout())
    return ds["dyadic_events"].select("event_id", "source_id", "target_id", "start", "end", "duration_seconds", "measurement_value")


@query(f"""WITH {RAW} SELECT count(*) FILTER (event_id % 101 = 0) AS broken, count(*) FILTER (event_id % 101 <> 0 AND (b IS NULL OR s IS NULL)) AS lacking, count(*) AS n FROM r WHERE event_id % 101 = 0 OR b IS NULL OR s IS NULL""", tables=False)
def src_text_rejects(spark, sf_dir):
    """SRC-22, SRC-24, SRC-25: the lines that a layout doesn't take, none of which is lost."""
    _, rejects = text.pair_dataset(spark, "text", _pair_file(spark, sf_dir), _pair_layout())
    broken = F.contains("line", F.lit("n/a"))
    return rejects.agg(F.count_if(broken).alias("broken"), F.count_if(~broken).alias("lacking"), F.count("*").alias("n"))


@query("""SELECT group_id AS group_event_id, min(start) // 1000000 AS second, count(DISTINCT node_id) AS members FROM memberships WHERE node_id % 40 <> 8 GROUP BY ALL""")
def src_text_groups(spark, sf_dir):
    """SRC-11, SRC-12, SRC-16, SRC-19: groups from files with a row for each member."""
    m = canonical.memberships(spark, sf_dir)
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")
    path = _written(spark, m.select(F.col("group_id").alias("key"), (F.col("start") / 1_000_000).cast("long").alias("began"), F.when(F.col("node_id") % 40 != 8, F.col("node_id").cast("string")).alias("tag"), twice), "groups")
    layout = text.Layout("key string, began long, tag string, copy int", {"group_event_id": "key", "node_id": "tag", "start": "began * 1000000", "end": "began * 1000000 + 3600000000"}, ("group_event_id", "node_id"), separator=";")
    ds, _ = text.group_dataset(spark, "text", path, layout, ["group_event_id", "start", "end"])
    n = ds["group_memberships"].groupBy("group_event_id").agg(F.count("*").alias("members"))
    return ds["group_events"].join(n, "group_event_id").select("group_event_id", (F.col("start") / 1_000_000).cast("long").alias("second"), "members")


@query(f"""+ o AS (SELECT source_id, start, kind, lag(start) OVER w AS p, lag(kind) OVER w AS q FROM dyads WINDOW w AS (PARTITION BY source_id ORDER BY start, kind)),
m AS (SELECT *, coalesce(start - p > {DAY}, false)::INT AS g, (p IS NULL OR coalesce(start - p > {DAY}, false) OR q <> kind)::INT AS f FROM o), n AS (SELECT *, sum(g) OVER w AS segment, sum(f) OVER w AS run FROM m WINDOW w AS (PARTITION BY source_id ORDER BY start, kind ROWS UNBOUNDED PRECEDING))
SELECT source_id, min(segment)::BIGINT AS segment, any_value(kind) AS kind, min(start) AS first, max(start) AS last, count(*) AS n FROM n GROUP BY source_id, run""")
def int_constant_runs(spark, sf_dir):
    """SRC-19, SRC-20, INT-04: runs of one kind in each node's series, cut at gaps of more than a day."""
    return intervals.constant_runs(canonical.dyads(spark, sf_dir), ["source_id"], "start", "kind", DAY)
