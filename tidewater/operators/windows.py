"""Evaluation windows that history and future support, and the nodes that may be chosen in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import intervals


def _supported(events: DataFrame, members: DataFrame, spans: DataFrame, key: list[str], low: str, high: str, width: int) -> DataFrame:
    """(key, event, node) of the events that overlap each span, by member."""
    met = intervals.range_join(events.select("unit", "event", "start", "end"), spans.select(*key, low, high), ["unit"], ("start", "end"), (low, high), width)
    return met.select(*key, "event").join(members.select("event", "node").distinct(), "event")


def supported_windows(events: DataFrame, members: DataFrame, anchors: DataFrame, least: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Windows that can be evaluated, and their eligible nodes.

    `anchors` are (unit, history_start, anchor, horizon_end), `events` (unit, event, start, end) and `members` (event, node).
    A node is eligible if it takes part in at least `least` events of the history. A window stands if two nodes or more are
    eligible, and two or more of them meet in its future in events that hold two of them; windows of a unit are numbered.
    Returns (unit, history_start, anchor, horizon_end, number, eligible, active, future_events) and (unit, anchor, node, support).
    """
    key = ["unit", "anchor"]
    past = anchors.select("unit", F.col("anchor").alias("a"), "history_start", F.col("anchor").alias("until"))
    support = _supported(events, members, past, ["unit", "a"], "history_start", "until", width)
    support = support.groupBy("unit", "a", "node").agg(F.countDistinct("event").alias("support")).where(F.col("support") >= least)
    ahead = anchors.select("unit", F.col("anchor").alias("a"), F.col("anchor").alias("since"), "horizon_end")
    future = _supported(events, members, ahead, ["unit", "a"], "since", "horizon_end", width).join(support.select("unit", "a", "node"), ["unit", "a", "node"], "left_semi")
    enough = future.groupBy("unit", "a", "event").agg(F.count("*").alias("n")).where("n > 1")
    active = future.join(enough, ["unit", "a", "event"]).groupBy("unit", "a").agg(F.countDistinct("node").alias("active"), F.countDistinct("event").alias("future_events")).where("active > 1")
    counted = support.groupBy("unit", "a").agg(F.count("*").alias("eligible")).where("eligible > 1")
    windows = anchors.withColumnRenamed("anchor", "a").join(counted, ["unit", "a"]).join(active, ["unit", "a"])
    number = F.row_number().over(Window.partitionBy("unit").orderBy("a"))
    windows = windows.select("unit", "history_start", F.col("a").alias("anchor"), "horizon_end", number.alias("number"), "eligible", "active", "future_events")
    nodes = support.withColumnRenamed("a", "anchor").join(windows.select(*key), key, "left_semi").select("unit", "anchor", "node", "support")
    return windows, nodes


def block_anchors(events: DataFrame, block: Column, length: int, history: int, indices: list[int] | None = None) -> DataFrame:
    """(unit, history_start, anchor, horizon_end, index): anchors at observed blocks, such as weekends, after `history` earlier ones.

    Blocks are those that a unit has events in, numbered from 0; unobserved ones between them don't count. `block` is a block's
    start and `length` how long it is; `indices` picks some blocks to forecast.
    """
    seen = events.where("end > start").select("unit", block.alias("at")).distinct()
    of = Window.partitionBy("unit").orderBy("at")
    seen = seen.withColumns({"index": F.row_number().over(of) - 1, "history_start": F.lag("at", history).over(of)}).where(F.col("index") >= history)
    if indices is not None:
        seen = seen.where(F.col("index").isin(indices))
    return seen.select("unit", "history_start", F.col("at").alias("anchor"), (F.col("at") + length).alias("horizon_end"), "index")
