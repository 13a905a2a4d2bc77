"""What is known of candidates from the history before an anchor, from pairs and groups, and checks of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators import intervals, partners
from tidewater.operators.turns import Turns

CONTEXT = ["network", "begin", "anchor"]
#: Groups up to this size give their partners as pairs.
PAIRED = partners.PAIRED


def stream_features(events: DataFrame, members: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """One row for each label (network, begin, anchor, node): the node's activity in [begin, anchor).

    `events` are (network, event, start, end, rate, location_id), pairs and groups alike, and `members` (event, node).
    Events are clipped to the history; their moment is their end, or the anchor. A context's labels are its eligible nodes.
    Partners are counted once however often they are met: those of small groups as pairs, those of large ones in tiles
    (`partners`). Candidates without events get zeros. Nothing of or after the anchor is read into a feature.
    """
    contexts = labels.select(*CONTEXT).distinct()
    members = members.where("node is not null").distinct()
    sizes = members.groupBy("event").agg(F.count("*").alias("n")).where("n > 1")
    held = intervals.range_join(events, contexts, ["network"], ("start", "end"), ("begin", "anchor"), width).join(sizes, "event")
    e = F.least("end", "anchor")
    held = held.select(*CONTEXT, "event", "n", "rate", "location_id", e.alias("at"), ((e - F.greatest("start", "begin")) / 1e6).alias("seconds"))
    rows = held.join(members, "event")
    half = F.col("anchor") - (F.col("anchor") - F.col("begin")) / 2
    sums = rows.groupBy(*CONTEXT, "node").agg(
        F.count("*").alias("activity"), F.sum(F.col("seconds") * (F.col("n") - 1)).alias("opportunity"), F.sum(F.col("seconds") * F.col("rate")).alias("exposure"), F.sum("n").alias("sizes"),
        F.countDistinct("location_id").alias("locations"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("at") >= half).alias("recent"))
    turns = Turns(events.sparkSession)
    number = turns.kept(ranks.numbered(members, "node", "i"), "nodes")
    met = rows.select(*CONTEXT, "event", "node", "n").join(number, "node").join(ranks.numbered(sizes, "event", "g"), "event")
    met = turns.kept(met.select(*CONTEXT, "g", "i", "n"), "members")
    eligible = labels.select(*CONTEXT, "node").distinct().join(number, "node").select(*CONTEXT, "i")
    met = partners.partner_counts(met, eligible, CONTEXT, number.count(), PAIRED).join(number, "i").select(*CONTEXT, "node", "partners", "fit")
    many = labels.groupBy(*CONTEXT).agg(F.countDistinct("node").alias("population"))
    x = labels.select(*CONTEXT, "node").distinct().join(many, CONTEXT).join(sums, [*CONTEXT, "node"], "left").join(met, [*CONTEXT, "node"], "left")
    span = (F.col("anchor") - F.col("begin")) / 1e6
    or0 = lambda c: F.coalesce(c, F.lit(0))
    a = or0("activity")
    return x.select(
        *CONTEXT, "node", a.alias("activity_count"), (a * 86400 / span).alias("event_rate_per_day"), (or0("opportunity") / span).alias("contact_opportunity_rate"), (or0("exposure") / span).alias("weighted_exposure_rate"),
        (or0("fit") / F.greatest(F.col("population") - 1, F.lit(1))).alias("eligible_partner_fraction"), or0("partners").alias("observed_partner_count"), or0("locations").alias("location_count"),
        F.when(a > 0, F.col("sizes") / a).otherwise(0.0).alias("mean_group_size"), F.greatest(F.lit(0.0), F.lit(1.0) - (F.col("anchor") - F.coalesce("last", "begin")) / 1e6 / span).alias("recency_score"),
        F.when(a > 0, F.col("recent") / a).otherwise(0.0).alias("recent_activity_fraction"), F.when(a > 1, (F.col("last") - F.col("first")) / 1e6 / span).otherwise(0.0).alias("active_span_fraction"))


def constant_by_key(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns) with one row a key; a column with several values in a key, null being one, raises an error."""
    checked = df.groupBy(*keys).agg(*(F.first(c).alias(c) for c in columns), *((F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"_{c}") for c in columns))
    kind = dict(df.dtypes)
    held = [F.when(F.col(f"_{c}") <= 1, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} isn't constant within {', '.join(keys)}")).cast(kind[c])).alias(c) for c in columns]
    return checked.select(*keys, *held)


def label_checks(df: DataFrame, context: list[str], candidate: str, label: str, population: str, value: str, share: str, times: tuple[str, str, str]) -> DataFrame:
    """(check, n): rows, or contexts, that break a rule of model-ready labels; all are 0 for labels that may be used.

    Nothing is null; label ids are unique; history start, anchor and horizon end follow each other; values lie in
    [-1, 1] and shares in [0, 1]; and a context has as many candidates as it says that its population has.
    """
    a, b, c = times
    null = F.lit(False)
    for name in df.columns:
        null = null | F.col(name).isNull()
    bad = df.agg(
        F.count_if(null).alias("no_missing_values"), F.count_if(~((F.col(a) < F.col(b)) & (F.col(b) < F.col(c)))).alias("strict_time_order"),
        F.count_if(~(F.col(value).between(-1, 1) & F.col(share).between(0, 1))).alias("value_ranges"))
    rows = bad.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in bad.columns))).alias("x")).select("x.check", "x.n")
    again = df.groupBy(label).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("unique_label_id").alias("check"), "n")
    cover = df.groupBy(*context).agg(F.countDistinct(candidate).alias("c"), F.min(population).alias("p"), F.max(population).alias("q")).where("c <> p or p <> q or p is null")
    return rows.union(again).union(cover.agg(F.count("*").alias("n")).select(F.lit("complete_candidate_coverage").alias("check"), "n"))
