"""Interval operators on BIGINT columns `start` and `end`, half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clipped(df: DataFrame, low: int, high: int) -> DataFrame:
    """Intervals that meet [low, high), cut to it."""
    return df.where((F.col("start") < high) & (F.col("end") > low)).withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))})


def islands(df: DataFrame, by: list[str], tolerance: int = 0) -> DataFrame:
    """(by, start, end, n_merged): unions of intervals that overlap, touch, or lie at most `tolerance` apart."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reached.isNull() | (F.col("start") > reached + tolerance)).cast("int")
    marked = df.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged")).drop("island")


def coverage(df: DataFrame, by: list[str], low: int, high: int) -> DataFrame:
    """(by, covered): the share of [low, high) that the union of each group's intervals covers, 0 where none does."""
    some = islands(clipped(df, low, high), by).groupBy(*by).agg((F.sum(F.col("end") - F.col("start")) / (high - low)).alias("covered"))
    return df.select(*by).distinct().join(some, by, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def cut_at(df: DataFrame, points: list[int]) -> DataFrame:
    """Each interval cut at the given points inside it; `part` counts its pieces."""
    inside = F.array_sort(F.array_distinct(F.filter(F.array(*(F.lit(p).cast("long") for p in points)), lambda p: (p > F.col("start")) & (p < F.col("end")))))
    edges = F.concat(F.array("start"), inside, F.array("end"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(i.alias("part"), F.get(edges, i).alias("start"), F.get(edges, i + 1).alias("end")))
    rest = [c for c in df.columns if c not in ("start", "end")]
    return df.where("`end` > start").select(*rest, F.explode(pieces).alias("_p")).select(*rest, "_p.part", "_p.start", "_p.end")


def reduced(segments: DataFrame, phases: DataFrame, targets: DataFrame) -> DataFrame:
    """Multipliers of cut dyads under phases (phase, start, end, residual) that target nodes (phase, node).

    The phase whose half-open span holds a segment's middle multiplies by the residual once for each
    targeted end. Phases are few and must not overlap.
    """
    middle = (F.col("start") + F.col("end")) / 2
    active = F.broadcast(phases.select("phase", F.col("start").alias("_a"), F.col("end").alias("_b"), "residual"))
    at = segments.join(active, (middle >= F.col("_a")) & (middle < F.col("_b")), "left").drop("_a", "_b")
    end = lambda c: targets.select("phase", F.col("node").alias(c), F.lit(1).alias(f"_{c}"))
    at = at.join(end("source_id"), ["phase", "source_id"], "left").join(end("target_id"), ["phase", "target_id"], "left")
    hits = F.coalesce("_source_id", F.lit(0)) + F.coalesce("_target_id", F.lit(0))
    return at.withColumn("multiplier", F.col("multiplier") * F.when(hits > 0, F.pow("residual", hits)).otherwise(1.0)).drop("_source_id", "_target_id", "residual")


def segments(df: DataFrame, every: int, origin: int = 0) -> DataFrame:
    """Each interval cut at the multiples of `every` after `origin`; `part` counts its pieces."""
    return windows(df, origin, every, every, "at").withColumn("part", (F.col("at") - F.floor((F.col("whole_start") - origin) / every)).cast("int")).drop("at")


def windows(df: DataFrame, origin: int | Column, width: int, step: int, name: str = "window") -> DataFrame:
    """A row for each window [origin + k * step, + width) that an interval meets, clipped to it.

    Windows are found by arithmetic on each row, without a join: `window` is k, and `whole_start` and
    `whole_end` keep the interval.
    """
    origin = origin if isinstance(origin, Column) else F.lit(origin)
    first = F.greatest(F.lit(0), F.floor((F.col("start") - origin - width) / step) + 1)
    last = F.floor((F.col("end") - 1 - origin) / step)
    met = df.where((F.col("end") > F.col("start")) & (last >= first)).withColumn(name, F.explode(F.sequence(first, last)))
    begin = origin + F.col(name) * step
    return met.withColumns({
        "whole_start": F.col("start"), "whole_end": F.col("end"), "start": F.greatest("start", begin), "end": F.least("end", begin + width)})


def rolling_anchors(spans: DataFrame, lookback: int, horizon: int, step: int) -> DataFrame:
    """(anchor, history_start, horizon_end) of each row (low, high): anchors with a whole history and horizon."""
    some = spans.where(F.col("high") - F.col("low") >= lookback + horizon)
    at = some.withColumn("anchor", F.explode(F.sequence(F.col("low") + lookback, F.col("high") - horizon, F.lit(step).cast("long"))))
    return at.withColumns({"history_start": F.col("anchor") - lookback, "horizon_end": F.col("anchor") + horizon}).drop("low", "high")


def decayed(start: Column, end: Column, anchor: Column | int, half_life: float) -> Column:
    """Length of an interval that halves with its middle's distance from the anchor."""
    anchor = anchor if isinstance(anchor, Column) else F.lit(anchor)
    return (end - start) * F.pow(F.lit(0.5), (anchor - (start + end) / 2.0) / half_life)


def coarse_decayed(start: Column, end: Column, low: Column | int, high: Column | int, half_life: float, grain: int = 0) -> Column:
    """Length of an interval's part in [low, high) that halves with its middle's age at `high`; 0 where there is none.

    With a grain the age is rounded up to a multiple of it, so that a coarser clock never makes a contact more recent.
    """
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    a, b = F.greatest(start, low), F.least(end, high)
    age = F.greatest(F.lit(0.0), high - (a + b) / 2.0)
    if grain:
        age = F.ceil(age / grain) * grain
    return F.when(b > a, (b - a) * F.pow(F.lit(0.5), age / half_life)).otherwise(0.0)


def range_join(left: DataFrame, right: DataFrame, on: list[str], span: tuple[str, str], other: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows alike in `on` whose half-open intervals `span` of `left` and `other` of `right` overlap, each pair once.

    Both sides are cut at the multiples of `width` and joined on key and bucket, so that a hot key is spread over its
    buckets and only intervals of one bucket are compared; a pair that shares several buckets is told in the first of
    them. Nulls and intervals without length overlap nothing. The columns of both sides but `on` must differ.
    """
    (a, b), (c, d) = span, other

    def cut(df, first, last, name):
        low, high = F.floor(F.col(first) / width), F.floor((F.col(last) - 1) / width)
        return df.where(F.col(last) > F.col(first)).withColumn(name, low).withColumn("_bucket", F.explode(F.sequence(low, high)))

    both = cut(left, a, b, "_left").join(cut(right, c, d, "_right"), [*on, "_bucket"])
    both = both.where((F.col("_bucket") == F.greatest("_left", "_right")) & (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return both.drop("_bucket", "_left", "_right")


def coverage_of(spans: DataFrame, windows: DataFrame, by: list[str], span: tuple[str, str], window: tuple[str, str], width: int) -> DataFrame:
    """(by, window, first, last, covered) of each row of `windows` (by, window): what the union of overlapping spans covers.

    `first` and `last` are those of the clipped spans, null where none overlaps; `covered` is in units of time.
    """
    (a, b), (c, d) = span, window
    keys = [*by, c, d]
    met = range_join(spans.select(*by, a, b), windows.select(*keys).distinct(), by, span, window, width)
    met = met.select(*keys, F.greatest(a, c).alias("start"), F.least(b, d).alias("end"))
    whole = islands(met, keys).groupBy(*keys).agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("covered"))
    return windows.select(*keys).distinct().join(whole, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def constant_runs(df: DataFrame, by: list[str], at: str, state: str, gap: int) -> DataFrame:
    """(by, segment, state, first, last, n): rows of a series that follow each other in one state.

    A run ends where the state changes or the next row is more than `gap` later; a gap also begins the next segment, from 0
    on. Rows of one moment are in the order of their states; a null state is a state like others.
    """
    order = Window.partitionBy(*by).orderBy(at, state)
    before, was = F.lag(at).over(order), F.lag(state).over(order)
    apart = F.coalesce(F.col(at) - before > gap, F.lit(False))
    fresh = apart | before.isNull() | ~was.eqNullSafe(F.col(state))
    marked = df.select(*by, at, state, apart.cast("int").alias("_gap"), fresh.cast("int").alias("_new"))
    marked = marked.withColumns({"segment": F.sum("_gap").over(order), "_run": F.sum("_new").over(order)})
    return marked.groupBy(*by, "_run").agg(F.min("segment").alias("segment"), F.first(state).alias(state), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_run")
