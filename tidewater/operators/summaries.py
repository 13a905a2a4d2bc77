"""Summaries of effects: spread of a context, gates of a family, two levers, nested thresholds, predictions.

All are grouped aggregates with partial sums on the map side; none needs the rows of a group together
but `median`, which merges counts of values. Null values count nowhere; a group without any value
keeps its row with null figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """Size, distinct values (after rounding), deviation, fractions by sign, extremes and their distance, of each context."""
    v = F.col(value)
    out = df.groupBy(*by).agg(
        F.count(v).alias("size"), F.count_distinct(F.round(v, digits)).alias("n_values"), F.stddev_samp(v).alias("sd"),
        F.avg((v > 0).cast("double")).alias("positive"), F.avg((v < 0).cast("double")).alias("negative"), F.min(v).alias("low"), F.max(v).alias("high"))
    return out.withColumn("spread", F.col("high") - F.col("low"))


def gates(contexts: DataFrame, by: list[str], anchor: str, varies: Column, least_fraction: float, least_anchors: int) -> DataFrame:
    """Of each family: its contexts, the fraction that varies, distinct anchors that vary, whether any does, and the verdict."""
    out = contexts.groupBy(*by).agg(
        F.count("*").alias("contexts"), F.avg(varies.cast("double")).alias("varying"), F.count_distinct(F.when(varies, F.col(anchor))).alias("anchors"), F.bool_or(varies).alias("any_varies"),
        F.median("spread").alias("median_spread"), F.avg(F.when(varies, F.col("spread"))).alias("mean_spread_varying"))
    return out.withColumn("qualifies", (F.col("varying") >= least_fraction) & (F.col("anchors") >= least_anchors))


def levers(df: DataFrame, by: list[str], arm: str, value: str, cells: list[str]) -> DataFrame:
    """Effects of two levers and what they do together; `cells` names the arms with neither, the first, the second and both."""
    out = df.groupBy(*by).agg(*(F.max(F.when(F.col(arm) == c, F.col(value))).alias(f"_{k}") for k, c in enumerate(cells)))
    none, one, two, both = (F.col(f"_{k}") for k in range(4))
    return out.select(*by, (none - one).alias("first_alone"), (none - two).alias("second_alone"), (none - both).alias("together"), (one + two - none - both).alias("interaction"))


def nested(df: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """Whether `value` never rises from one level to the next; a level is one row, and null values are skipped."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(level))
    seen = df.where(F.col(value).isNotNull()).withColumn("_held", F.coalesce(F.col(value) <= before, F.lit(True)))
    return seen.groupBy(*by).agg(F.count("*").alias("levels"), F.bool_and("_held").alias("nested"))


def prediction_scores(df: DataFrame, by: list[str], chance: str, came: str, expected: str, observed: str, weight: str) -> DataFrame:
    """Brier score, and absolute error by weight; without any weight, the plain mean error."""
    off, w = F.abs(F.col(expected) - F.col(observed)), F.col(weight)
    total = F.sum(w)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col(chance) - F.col(came), F.lit(2.0))).alias("brier"),
        F.when(total > 0, F.sum(w * off) / F.when(total > 0, total)).otherwise(F.avg(off)).alias("error"))


def curve_slopes(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope over the means of `y` at each `x`; null where x takes one value."""
    means = df.groupBy(*by, x).agg(F.avg(y).alias("_y"))
    return means.groupBy(*by).agg(F.count("*").alias("points"), F.regr_slope(F.col("_y"), F.col(x).cast("double")).alias("slope"))


def mean_competitors(memberships: DataFrame, by: list[str], group: str, seconds: str) -> DataFrame:
    """Mean number of other members that a member meets, by time: each group weighs its length times its size."""
    sizes = memberships.groupBy(*by, group).agg(F.count("*").alias("_n"), F.max(seconds).alias("_s"))
    w = F.col("_s") * F.col("_n")
    return sizes.groupBy(*by).agg(F.sum("_n").alias("members"), (F.sum(w * (F.col("_n") - 1)) / F.sum(w)).alias("competitors"))


def pooled(df: DataFrame, by: list[str], source: str, value: str) -> DataFrame:
    """Effects by any keys, null keys included: mean, median, extremes, counts by sign and the sources in order."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v > 0).alias("above"), F.count_if(v < 0).alias("below"),
        F.concat_ws(" | ", F.sort_array(F.collect_set(source))).alias("sources"))  # a fixed vocabulary of sources
