"""Bootstraps over nested levels (families, their units, the units' contexts ...) from keyed draws.

A mean of means over drawn families, drawn units of each and so on is linear in the lowest rows, so a replicate is told by
how often each row is drawn. Counts go down the levels: a family drawn n times makes n draws of as many units as it has,
a unit drawn m times makes m draws of its contexts. Draws carry places only; values meet the counts at the end. A draw depends
on seed, group, replicate, level, parent and its number, not on the partitioning. They are dealt to tasks in blocks before
they are made, and move once: to the rows that they draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import keyed, ranks
from tidewater.operators.turns import Turns

#: Draws of one task at most, and where more tasks are to be had at least; draws that are made from one row.
DRAWS, FEW, BLOCK = 2_000_000, 50_000, 10_000


def nested_means(df: DataFrame, by: list[str], levels: list[str], value: str) -> DataFrame:
    """(by, levels[0], value): means of means, from the lowest level up to the first; nulls are left out."""
    x = df.where(F.col(value).isNotNull())
    for k in range(len(levels), 0, -1):
        x = x.groupBy(*by, *levels[:k]).agg(F.avg(value).alias(value))
    return x


def _parts(rows: DataFrame, replicates: int) -> int:
    """Tasks for the draws of these rows: a row is drawn once a replicate, on average."""
    draws = rows.count() * replicates
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-draws // DRAWS), min(most, -(-draws // FEW)))


def multilevel_bootstrap(df: DataFrame, by: list[str], levels: list[str], value: str, replicates: int, seed: int, level: float = 0.95, one_of_last: bool = False) -> DataFrame:
    """(by, families, contexts, mean, low, high, positive_share, p_positive) of each group.

    `levels` go from the first to the last; rows alike in all of them are averaged before. `mean` is the mean of the first
    level's means of means, `positive_share` the share of these above 0, `p_positive` the share of replicates above 0.
    With `one_of_last`, a row above the last level takes one of its rows only, as for replicates of a shuffle. Rows with a null
    in a level or the value are left out; a null in `by` is a group like others.
    """
    turns = Turns(df.sparkSession)
    some = df.dropna(subset=[value, *levels]).withColumn("_key", F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(1).alias("_all")))
    keyed_rows = turns.kept(some.groupBy("_key", *levels).agg(F.avg(value).alias("_v")), "rows")
    group = F.concat_ws("\x1e", *(F.col(f"_key.{c}").cast("string") for c in by)) if by else F.lit("")
    groups = turns.kept(ranks.numbered(keyed_rows, "_key", "_g").withColumn("_name", group), "groups")
    rows = turns.kept(keyed_rows.join(groups.select("_key", "_g"), "_key").select("_g", *levels, "_v"), "numbered")
    turns.drop("rows")
    given, by = by, ["_g"]
    drawn = groups.select("_g", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"), F.lit(1).cast("long").alias("_hits"))
    weights = groups.select("_g", F.lit(1.0).alias("_w"))
    for k, name in enumerate(levels):
        above = levels[:k]
        at = [*by, *above]
        last = k == len(levels) - 1
        one = one_of_last and last
        of = Window.partitionBy(*at)
        here = (rows if last else rows.select(*at, name).distinct()).withColumns({"_i": (F.row_number().over(of.orderBy(name)) - 1).cast("long"), "_size": F.count("*").over(of)})
        here = turns.kept(here.join(weights, at).withColumn("_w", F.col("_w") / (F.lit(1) if one else F.col("_size"))), f"level{k}")
        parts = _parts(here, replicates)
        trials = F.col("_hits") if one else F.col("_hits") * F.col("_size")
        parent = F.concat_ws("\x1e", *(F.col(c).cast("string") for c in above)) if above else F.lit("")
        asked = drawn.join(here.groupBy(*at).agg(F.max("_size").alias("_size")), at).join(groups.select("_g", "_name"), "_g")
        asked = asked.select(*at, "_r", "_size", "_name", trials.alias("_trials")).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_trials") - 1, F.lit(BLOCK).cast("long"))))
        asked = asked.repartition(parts, *at, "_r", "_from").withColumn("_q", F.explode(F.sequence("_from", F.least(F.col("_from") + BLOCK, "_trials") - 1)))
        place = F.floor(keyed.uniform(seed, F.col("_name"), F.col("_r"), k, parent, F.col("_q")) * F.col("_size"))
        hits = asked.select(*at, "_r", place.alias("_i")).repartition(parts, *at, "_i").groupBy(*at, "_i", "_r").agg(F.count("*").alias("_hits"))
        met = hits.join(here.drop("_size"), [*at, "_i"])
        if not last:
            drawn = turns.kept(met.select(*at, name, "_r", "_hits"), f"drawn{k}")
            weights = here.select(*at, name, "_w")
    each = met.groupBy(*by, "_r").agg(F.sum(F.col("_hits") * F.col("_w") * F.col("_v")).alias("_m"))
    tail = (1 - level) / 2
    ends = each.groupBy(*by).agg(F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high"), F.avg((F.col("_m") > 0).cast("double")).alias("p_positive"))
    first = nested_means(rows, by, levels, "_v")
    point = first.groupBy(*by).agg(F.count("*").alias("families"), F.avg("_v").alias("mean"), F.avg((F.col("_v") > 0).cast("double")).alias("positive_share"))
    # what the first level's means are means of, without the draws of the last level
    counted = rows.select(*by, *(levels[:-1] if one_of_last else levels)).distinct().groupBy(*by).agg(F.count("*").alias("contexts"))
    out = point.join(counted, by).join(ends, by).join(groups, by)
    return out.select(*(F.col(f"_key.{c}").alias(c) for c in given), "families", "contexts", "mean", "low", "high", "positive_share", "p_positive")
