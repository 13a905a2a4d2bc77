"""From interactions to weighted contact between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators import partners, tiles
from tidewater.operators.turns import Turns


def issues(dyads: DataFrame) -> DataFrame:
    """(severity, code, n, fraction) of each quality check, in one pass besides that for repeated ids."""
    checks = {
        ("high", "self_loop"): F.col("source_id") == F.col("target_id"), ("critical", "missing_endpoint"): F.col("source_id").isNull() | F.col("target_id").isNull(),
        ("high", "reversed_time"): F.col("end") < F.col("start"), ("medium", "zero_duration"): F.col("end") == F.col("start"),
        ("critical", "missing_time"): F.col("start").isNull() | F.col("end").isNull(), ("medium", "not_finite"): F.isnan("weight")}
    counts = dyads.agg(F.count("*").alias("all"), *(F.count_if(c).alias(code) for (_, code), c in checks.items()))
    again = dyads.groupBy("event_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("duplicate_id"))
    rows = [*checks, ("critical", "duplicate_id")]
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col(c).alias("n")) for s, c in rows))).alias("x")
    both = counts.crossJoin(again)  # one row and one row
    return both.select("all", each).select("x.severity", "x.code", "x.n", F.coalesce(F.col("x.n") / F.col("all"), F.lit(0.0)).alias("fraction"))


def association_rates(dyads: DataFrame, scale: float, top: float) -> DataFrame:
    """Hazard a second of an association index, linear in it and saturating."""
    index, seconds = F.col("weight") / top, (F.col("end") - F.col("start")) / 1e6
    return dyads.where("end > start and source_id <> target_id").select(
        "event_id", (scale * index / seconds).alias("linear"), (scale * (1 - F.exp(-index)) / seconds).alias("saturating"))


#: Members of a group that meet in one task.
BLOCK = 512


def group_pairs(memberships: DataFrame, seconds: float, diluted: bool = True) -> DataFrame:
    """(a, b, n_events, contact_seconds): pairs of nodes by the time spent in one group, over n - 1 if diluted.

    Pairs are added up in tiles of nodes where copies of memberships are fewer than pairs, and are joined elsewhere.
    """
    turns = Turns(memberships.sparkSession)
    some = turns.kept(memberships.select("group_id", "node_id"), "memberships")
    size = turns.kept(tiles.sizes(some), "sizes")
    if tiles.pays(size, some.select("node_id")):
        return tiles.pairs(tiles.blocks(turns, some, size), seconds, diluted)
    return joined_pairs(some, seconds, diluted)


def joined_pairs(memberships: DataFrame, seconds: float, diluted: bool = True) -> DataFrame:
    """`group_pairs` by a join of memberships.

    Groups of one node are left out before pairs are made. Members are dealt into blocks of BLOCK; each
    pair of blocks is a join key of its own, so a large group is spread over many tasks.
    """
    size = memberships.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2")
    some = memberships.select("group_id", "node_id").join(size, "group_id").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    some = some.withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = some.where("block <= other").select("group_id", F.col("block").alias("lo"), F.col("other").alias("hi"), "n", F.col("node_id").alias("x"))
    right = some.where("block >= other").select("group_id", F.col("other").alias("lo"), F.col("block").alias("hi"), F.col("node_id").alias("y"))
    share = F.lit(seconds) / (F.col("n") - 1) if diluted else F.lit(seconds)
    pairs = left.join(right, ["group_id", "lo", "hi"]).where("lo < hi and x <> y or x < y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n_events"), F.sum(share).alias("contact_seconds"))


def both_ways(pairs: DataFrame, weight: str) -> DataFrame:
    """(node, partner, weight) from unordered pairs."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("partner")), F.struct(F.col("b").alias("node"), F.col("a").alias("partner")))).alias("p"), weight).select("p.node", "p.partner", weight)


def node_strength(pairs: DataFrame, weight: str) -> DataFrame:
    """(node, degree, strength)."""
    return both_ways(pairs, weight).groupBy("node").agg(F.count("*").alias("degree"), F.sum(weight).alias("strength"))


def group_strength(memberships: DataFrame, seconds: float) -> DataFrame:
    """(node, degree, strength): `node_strength` of `group_pairs`, without its pairs.

    What the n - 1 others of a group share is its whole time, so strength is a sum over groups; degrees are counted in tiles.
    """
    turns = Turns(memberships.sparkSession)
    some = memberships.select("group_id", "node_id").where("group_id is not null and node_id is not null")
    size = some.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2")
    some = some.join(size, "group_id")
    strength = some.groupBy(F.col("node_id").alias("node")).agg((F.count("*") * F.lit(float(seconds))).alias("strength"))
    who = turns.kept(ranks.numbered(some, "node_id", "i"), "nodes")
    what = turns.kept(ranks.numbered(size, "group_id", "g"), "groups")
    held = turns.kept(some.join(who, "node_id").join(what, "group_id").select("g", "i", "n"), "members")
    degree = partners.partner_counts(held, held.select("i").limit(0), [], who.count()).join(who, "i").select(F.col("node_id").alias("node"), F.col("partners").alias("degree"))
    return strength.join(degree, "node").select("node", "degree", "strength")


def endpoints(dyads: DataFrame) -> DataFrame:
    """(node, partner, other columns): each dyad from both of its ends."""
    rest = [c for c in dyads.columns if c not in ("source_id", "target_id")]
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("partner")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("partner"))))
    return dyads.where("source_id <> target_id").select(ends.alias("x"), *rest).select("x.node", "x.partner", *rest)


def history_features(clips: DataFrame, lookback: int) -> DataFrame:
    """Features of each (window, node) from the clipped ends of its events before the anchor; one event has no span.

    Events are summed by partner first, so that partners are counted and not told apart again.
    """
    seconds = (F.col("end") - F.col("start")) / 1e6
    late = F.col("start") - F.col("window_start") >= lookback / 2
    of_partner = clips.groupBy("window", "node", "partner").agg(
        F.count("*").alias("n"), F.sum(seconds).alias("seconds"), F.collect_set("kind").alias("kinds"), F.max("window_start").alias("ws"),
        F.max("end").alias("last"), F.min("start").alias("first"), F.count_if(late).alias("late"))  # kinds are a handful
    span = F.when(F.sum("n") > 1, (F.max("last") - F.min("first")) / lookback).otherwise(0.0)
    return of_partner.groupBy("window", "node").agg(
        F.sum("n").alias("activity_count"), F.sum("seconds").alias("contact_seconds"), F.count("*").alias("observed_partners"),
        F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).cast("long").alias("kinds"), (1 - (F.max("ws") + lookback - F.max("last")) / lookback).alias("recency"),
        (F.sum("late") / F.sum("n")).alias("recent_share"), span.alias("active_span"))
