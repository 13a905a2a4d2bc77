"""Exposure streams: mappers that turn a dataset's events into rates of contact, chosen by what the dataset holds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.dataset import DUPLICATE, Dataset, require_order

PAIRS = ["exposure_id", "source_id", "target_id", "start", "end", "rate", "directed", "route", "mapper", "origin", "location_id"]
GROUPS = ["group_event_id", "start", "end", "rate", "mode", "route", "mapper", "location_id"]
MEMBERS = ["group_event_id", "node_id", "membership_weight"]
#: Mappers by the names that label contracts record.
RECORDED = {
    "DurationContactMapper": "duration", "CoalescedDurationContactMapper": "coalesced", "DetectionIntervalMapper": "detection", "AggregatedAssociationMapper": "association",
    "GroupMixingMapper": "group_mixing"}


@dataclass
class Stream:
    """Pair exposures, group exposures and the members of these."""

    pairs: DataFrame
    groups: DataFrame
    members: DataFrame
    mapper: str

    def nodes(self) -> DataFrame:
        """(node_id) of all that take part."""
        return self.pairs.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).union(self.members.select("node_id")).where("node_id is not null").distinct()


def _no_pairs(ds: Dataset) -> DataFrame:
    return ds.spark.createDataFrame([], "exposure_id string, source_id string, target_id string, start long, end long, rate double, directed boolean, route string, mapper string, origin string, location_id string")


def _no_groups(ds: Dataset) -> tuple[DataFrame, DataFrame]:
    return ds.spark.createDataFrame([], "group_event_id string, start long, end long, rate double, mode string, route string, mapper string, location_id string"), ds.spark.createDataFrame([], "group_event_id string, node_id string, membership_weight double")


def _pairs(ds: Dataset, events: DataFrame, mapper: str, route: str, rate: Column) -> Stream:
    """Events of positive length that aren't flagged as copies, as exposures; an error where none is left."""
    good = events.where(~F.contains(F.coalesce("quality_flag", F.lit("")), F.lit(DUPLICATE)) & (F.col("end") > F.col("start")))
    made = good.select(
        F.concat(F.lit("exposure:"), "event_id").alias("exposure_id"), "source_id", "target_id", "start", "end", rate.cast("double").alias("rate"), F.coalesce("directed", F.lit(False)).alias("directed"),
        F.lit(route).alias("route"), F.lit(mapper).alias("mapper"), F.col("event_id").alias("origin"), "location_id")
    if made.isEmpty():
        raise ValueError(f"{ds.dataset_id} has no event of positive length for the mapper {mapper}")
    return Stream(made, *_no_groups(ds), mapper)


def coalesced(stream: Stream, mapper: str = "coalesced") -> Stream:
    """Exposures of a pair, route and place that overlap or touch as their union; its origins are a JSON array in their order.

    Overlapping exposures of different rates raise an error.
    """
    key = ["source_id", "target_id", "directed", "route", "location_id"]
    order = Window.partitionBy(*key).orderBy("start", "end", "origin")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("start") > before)).cast("int")
    marked = stream.pairs.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    joined = marked.groupBy(*key, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("rate").alias("rate"), F.max("rate").alias("_most"),
        F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "origin"))), lambda v: v["origin"]).alias("_from"))  # the records of one union
    rate = F.when(F.col("rate") == F.col("_most"), F.col("rate")).otherwise(F.raise_error(F.lit("overlapping exposures of different rates can't be joined")).cast("double"))
    name = F.concat_ws(":", F.lit("coalesced"), "source_id", "target_id", F.col("start").cast("string"))
    made = joined.withColumns({"rate": rate, "exposure_id": name, "mapper": F.lit(mapper), "origin": F.to_json("_from")})
    return replace(stream, pairs=made.select(*PAIRS), mapper=mapper)


def group_mixing(ds: Dataset, mode: str = "frequency_dependent", rate: float = 1.0) -> Stream:
    """Groups of positive length with their members; `mode` is "frequency_dependent" or "undiluted_clique"."""
    if mode not in ("frequency_dependent", "undiluted_clique"):
        raise ValueError(f"no mode {mode!r}")
    groups = ds["group_events"].where("end > start").select(
        "group_event_id", "start", "end", F.lit(float(rate)).alias("rate"), F.lit(mode).alias("mode"), F.lit("group_association_proxy").alias("route"), F.lit("group_mixing").alias("mapper"), "location_id")
    members = ds["group_memberships"].select(*MEMBERS)
    if groups.isEmpty() or members.isEmpty():
        raise ValueError(f"{ds.dataset_id} has no groups of positive length with members")
    return Stream(_no_pairs(ds), groups, members.join(groups.select("group_event_id"), "group_event_id", "left_semi"), "group_mixing")


def compiled(ds: Dataset, mapper: str, rate: float = 1.0, scale: float = 1.0, saturating: bool = False, semantics: tuple[str, ...] = ("sensor_proximity",)) -> Stream:
    """The stream of a mapper, by its name or the name that a label contract records."""
    name = RECORDED.get(mapper, mapper)
    if name not in RECORDED.values():
        raise ValueError(f"no mapper {mapper!r}")
    require_order(ds)
    events, near = ds["dyadic_events"], F.col("edge_semantics").isin(*semantics)
    if name == "group_mixing":
        return group_mixing(ds, rate=rate)
    if name == "association":
        value = F.col("measurement_value")
        weight = 1 - F.exp(-value) if saturating else value
        return _pairs(ds, events.where("measurement_type = 'association_index'"), name, "association_proxy", scale * weight / ((F.col("end") - F.col("start")) / 1e6))
    if name == "detection":
        return _pairs(ds, events.where((F.col("event_representation") == "fixed_bin") & near), name, "direct_contact_proxy", F.lit(rate))
    plain = _pairs(ds, events.where((F.col("measurement_type") == "duration") & near), "duration", "direct_contact", F.lit(rate))
    return plain if name == "duration" else coalesced(plain)


def primary_mapper(ds: Dataset) -> str:
    """The mapper that a dataset calls for: groups first, then associations, detections and durations; all of its events are asked."""
    if not ds["group_events"].isEmpty():
        return "group_mixing"
    has = lambda c, v: F.coalesce(F.bool_or(F.col(c) == v), F.lit(False))
    kinds = ds["dyadic_events"].agg(has("measurement_type", "association_index").alias("association"), has("event_representation", "fixed_bin").alias("detection"), has("measurement_type", "duration").alias("duration")).first()
    for name in ("association", "detection", "duration"):
        if kinds[name]:
            return name
    raise ValueError(f"no mapper fits the events of {ds.dataset_id}")


def primary(ds: Dataset) -> Stream:
    """The stream of the mapper that the dataset calls for."""
    return compiled(ds, primary_mapper(ds))


def _cut(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.where((F.col("start") < high) & (F.col("end") > low)).withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))})


def sliced(stream: Stream, low: int, high: int) -> Stream:
    """What meets [low, high), cut to it; members go with their groups."""
    groups = _cut(stream.groups, low, high)
    return replace(stream, pairs=_cut(stream.pairs, low, high), groups=groups, members=stream.members.join(groups.select("group_event_id"), "group_event_id", "left_semi"))


def restricted(stream: Stream, nodes: DataFrame) -> Stream:
    """Exposures among the given nodes (node_id); groups need two of them or more."""
    keep = nodes.select("node_id").distinct()
    pairs = stream.pairs
    for end in ("source_id", "target_id"):
        pairs = pairs.join(keep.withColumnRenamed("node_id", end), end, "left_semi")
    members = stream.members.join(keep, "node_id", "left_semi")
    enough = members.groupBy("group_event_id").agg(F.countDistinct("node_id").alias("n")).where("n > 1").select("group_event_id")
    return replace(stream, pairs=pairs.select(*PAIRS), groups=stream.groups.join(enough, "group_event_id", "left_semi").select(*GROUPS), members=members.join(enough, "group_event_id", "left_semi").select(*MEMBERS))


def shifted(stream: Stream, by: int) -> Stream:
    """All exposures moved in time."""
    move = {"start": F.col("start") + by, "end": F.col("end") + by}
    return replace(stream, pairs=stream.pairs.withColumns(move), groups=stream.groups.withColumns(move))


def replayed(stream: Stream, anchor: int, horizon_end: int) -> Stream:
    """The history just before an anchor, as long as the horizon, moved onto the horizon."""
    return shifted(sliced(stream, 2 * anchor - horizon_end, anchor), horizon_end - anchor)


def hosted(stream: Stream, individuals: DataFrame, species: str) -> Stream:
    """Groups with a member of a species, and those members only; an error where no individual is of it."""
    hosts = individuals.where(F.col("species") == species).select("node_id").distinct()
    if hosts.isEmpty():
        raise ValueError(f"no individual is of the species {species!r}")
    members = stream.members.join(hosts, "node_id", "left_semi").select(*MEMBERS)
    return replace(stream, pairs=stream.pairs.limit(0), groups=stream.groups.join(members.select("group_event_id"), "group_event_id", "left_semi").select(*GROUPS), members=members)


def first_events(stream: Stream, most: int) -> Stream:
    """The first `most` pairs and the first `most` groups by their start, ties by their ids, with the members of these."""
    groups = stream.groups.orderBy("start", "group_event_id").limit(most)
    return replace(stream, pairs=stream.pairs.orderBy("start", "exposure_id").limit(most), groups=groups, members=stream.members.join(groups.select("group_event_id"), "group_event_id", "left_semi").select(*MEMBERS))


def extent(stream: Stream) -> DataFrame:
    """One row (first, last): when the first exposure begins and the last one ends, null for an empty stream."""
    both = stream.pairs.select("start", "end").union(stream.groups.select("start", "end"))
    return both.agg(F.min("start").alias("first"), F.max("end").alias("last"))


def with_mode(stream: Stream, mode: str) -> Stream:
    """The stream with another way of mixing in all groups."""
    return replace(stream, groups=stream.groups.withColumn("mode", F.lit(mode)))


def combined(*streams: Stream) -> Stream:
    """All exposures of several streams; a member of a group is one, whoever names it."""
    first = streams[0]
    for s in streams[1:]:
        first = replace(first, pairs=first.pairs.unionByName(s.pairs), groups=first.groups.unionByName(s.groups), members=first.members.unionByName(s.members), mapper=f"{first.mapper}+{s.mapper}")
    return replace(first, members=first.members.groupBy("group_event_id", "node_id").agg(F.max("membership_weight").alias("membership_weight")).select(*MEMBERS))


def problems(stream: Stream) -> DataFrame:
    """(code, n) of what a valid stream doesn't have."""
    def of(df, prefix):
        bad = df.agg(
            F.count_if(F.col("start").isNull() | F.col("end").isNull()).alias("missing_time"), F.count_if(F.col("end") <= F.col("start")).alias("no_length"),
            F.count_if(F.col("rate").isNull() | F.isnan("rate") | (F.col("rate") < 0)).alias("bad_rate"))
        rows = F.explode(F.array(*(F.struct(F.lit(f"{prefix}_{c}").alias("code"), F.col(c).alias("n")) for c in bad.columns))).alias("x")
        return bad.select(rows).select("x.code", "x.n")

    lost = stream.members.select("group_event_id").distinct().join(stream.groups.select("group_event_id"), "group_event_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_members").alias("code"), "n")
    return of(stream.pairs, "pair").union(of(stream.groups, "group")).union(lost)


def events(stream: Stream, network: Column) -> tuple[DataFrame, DataFrame]:
    """Events (network, event, start, end, rate, divided) and members (event, node) of a stream, for measures in time."""
    pair = F.concat(F.lit("pair:"), "exposure_id").alias("event")
    group = F.concat(F.lit("group:"), "group_event_id").alias("event")
    some = stream.pairs.where("source_id <> target_id")
    one = some.select(network.alias("network"), pair, "start", "end", "rate", F.lit(False).alias("divided"))
    two = stream.groups.select(network.alias("network"), group, "start", "end", "rate", (F.col("mode") == "frequency_dependent").alias("divided"))
    ends = some.select(pair, F.explode(F.array("source_id", "target_id")).alias("node"))
    return one.union(two), ends.union(stream.members.where("node_id is not null").select(group, F.col("node_id").alias("node")).distinct())
