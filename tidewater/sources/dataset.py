"""The five canonical tables of a dataset, their checks, and observation windows.

Times are microseconds since 1970 (`start`, `end` and the like), names of nodes and events are strings. Columns that a table
lacks are null, and columns beyond the schema are dropped.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the canonical tables.
TABLES = {
    "individuals": "dataset_id string, node_id string, species string, sex string, age_class string, group_id string, first_observed_at long, last_observed_at long, attributes_json string",
    "dyadic_events": "dataset_id string, event_id string, source_id string, target_id string, start long, end long, duration_seconds double, event_representation string, edge_semantics string, "
                     "measurement_type string, measurement_value double, measurement_unit string, location_id string, directed boolean, native_time_resolution_seconds double, source_record_id string, "
                     "quality_flag string, attributes_json string",
    "group_events": "dataset_id string, group_event_id string, start long, end long, duration_seconds double, location_id string, event_semantics string, native_time_resolution_seconds double, "
                    "source_record_id string, quality_flag string, attributes_json string",
    "group_memberships": "dataset_id string, group_event_id string, node_id string, membership_weight double, source_record_id string, attributes_json string",
    "observation_windows": "dataset_id string, node_id string, window_start long, window_end long, observation_status string, device_id string, coverage_fraction double, reason string, attributes_json string",
}
#: Rows with this in their flag are exact copies of a source record: kept, but never mapped.
DUPLICATE = "exact_duplicate_source_record"


def _fields(name: str) -> list[tuple[str, str]]:
    return [tuple(p.strip().split(" ")) for p in TABLES[name].split(",")]


def table(df: DataFrame, name: str) -> DataFrame:
    """`df` with the columns of a canonical table, in their order and types."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _fields(name)))


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A canonical table without rows."""
    return spark.createDataFrame([], TABLES[name])


def attributes(**values: Column) -> Column:
    """Further values of a row as JSON with sorted names; nulls are left out."""
    return F.to_json(F.struct(*(v.alias(n) for n, v in sorted(values.items()))))


@dataclass
class Dataset:
    """The tables of a dataset by name; those that aren't given are empty. `ordered` says whether its times have an order."""

    spark: SparkSession
    dataset_id: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    ordered: bool = True
    notes: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        given = self.tables.get(name)
        made = empty(self.spark, name) if given is None else table(given, name)
        return made.withColumn("dataset_id", F.coalesce("dataset_id", F.lit(self.dataset_id)))

    def write(self, path: str) -> None:
        """All five tables as Parquet under one folder, and what describes them as a line of JSON."""
        for name in TABLES:
            self[name].write.mode("overwrite").parquet(f"{path}/{name}")
        line = json.dumps({"dataset_id": self.dataset_id, "ordered": self.ordered, "notes": self.notes}, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    def summary(self) -> DataFrame:
        """(name, n, first, last) of each table; tables without times have null bounds."""
        bounds = {"dyadic_events": ("start", "end"), "group_events": ("start", "end"), "observation_windows": ("window_start", "window_end"), "individuals": ("first_observed_at", "last_observed_at")}
        out = None
        for name in TABLES:
            low, high = (F.min(bounds[name][0]), F.max(bounds[name][1])) if name in bounds else (F.lit(None).cast("long"), F.lit(None).cast("long"))
            one = self[name].agg(F.count("*").alias("n"), low.alias("first"), high.alias("last")).select(F.lit(name).alias("name"), "n", "first", "last")
            out = one if out is None else out.union(one)
        return out


def read(spark: SparkSession, path: str) -> Dataset:
    """A dataset as `write` leaves it; its tables are read when they are used."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])  # one line
    tables = {n: spark.read.schema(", ".join(f"`{c}` {t}" for c, t in _fields(n))).parquet(f"{path}/{n}") for n in TABLES}
    return Dataset(spark, about["dataset_id"], tables, about["ordered"], about["notes"])


def _ends(events: DataFrame) -> DataFrame:
    return events.select(F.explode(F.array("source_id", "target_id")).alias("node_id"), "start", "end")


def _bounds(seen: DataFrame, dataset_id: str, reason: str) -> DataFrame:
    some = seen.where("node_id is not null").groupBy("node_id").agg(F.min("start").alias("window_start"), F.max("end").alias("window_end"))
    return table(some.withColumns({"dataset_id": F.lit(dataset_id), "observation_status": F.lit("detected_span"), "reason": F.lit(reason), "attributes_json": F.lit("{}")}), "observation_windows")


def windows_from_pairs(ds: Dataset) -> DataFrame:
    """Observation windows from each node's first to its last pair event."""
    return _bounds(_ends(ds["dyadic_events"]), ds.dataset_id, "Bounds of observed interactions; not continuous device uptime")


def windows_from_groups(ds: Dataset) -> DataFrame:
    """Observation windows from each node's first to its last group; members of unknown groups have no bounds."""
    seen = ds["group_memberships"].select("group_event_id", "node_id").join(ds["group_events"].select("group_event_id", "start", "end"), "group_event_id", "left")
    return _bounds(seen, ds.dataset_id, "Bounds of observed group memberships; not continuous device uptime")


def with_bounds(individuals: DataFrame, windows: DataFrame) -> DataFrame:
    """Individuals with the bounds of all of their windows in place of their own."""
    bounds = windows.groupBy("node_id").agg(F.min("window_start").alias("first_observed_at"), F.max("window_end").alias("last_observed_at"))
    return table(individuals.drop("first_observed_at", "last_observed_at").join(bounds, "node_id", "left"), "individuals")


def individuals_from(ds: Dataset, roster: DataFrame | None = None) -> DataFrame:
    """One row a name: those of the roster with its columns, the others by name only; empty and null names are left out."""
    seen = _ends(ds["dyadic_events"]).select("node_id").union(ds["group_memberships"].select("node_id")).where("node_id <> ''").distinct()
    if roster is not None:
        known = table(roster, "individuals").where("node_id <> ''").dropDuplicates(["node_id"])
        return table(known.unionByName(seen.join(known, "node_id", "left_anti"), allowMissingColumns=True).withColumn("dataset_id", F.lit(ds.dataset_id)), "individuals")
    return table(seen.withColumn("dataset_id", F.lit(ds.dataset_id)), "individuals")


def _count(df: DataFrame, code: str, what: Column | None = None, of: Column | None = None) -> DataFrame:
    return df.agg((F.count("*") if what is None else what).cast("long").alias("n"), (F.lit(None) if of is None else of).cast("long").alias("rows")).select(F.lit(code).alias("code"), "n", "rows")


#: Severity of each finding.
SEVERITY = {
    "duplicate_node_ids": "high", "missing_node_ids": "critical", "duplicate_event_ids": "high", "self_loops": "high", "missing_endpoints": "critical", "orphan_dyadic_nodes": "high",
    DUPLICATE: "medium", "negative_duration": "critical", "zero_duration": "medium", "duration_coordinate_mismatch": "medium", "reversed_time": "critical", "missing_temporal_coordinates": "high",
    "non_finite_measurement": "medium", "duplicate_group_ids": "high", "duplicate_group_membership": "high", "orphan_group_ids": "critical", "orphan_group_members": "high",
    "missing_group_time": "high", "reversed_group_time": "critical", "negative_group_duration": "critical", "zero_group_duration": "medium"}


def findings(ds: Dataset) -> DataFrame:
    """(severity, code, n, fraction) of every check, those without a finding too; a fraction is null where none is told.

    Each table is read a few times, always into counts: one aggregation for what a row tells by itself, and one for each
    check that compares rows or tables. Times may be missing where the dataset has no order, which then weighs less.
    """
    who, pairs, groups, members = (ds[n] for n in ("individuals", "dyadic_events", "group_events", "group_memberships"))
    every = F.count("*")
    again = lambda df, *keys: _again(df, list(keys))
    c = F.col
    seconds = (c("end") - c("start")) / 1e6
    no_time = c("start").isNull() | c("end").isNull()
    finite = c("measurement_value").isNotNull() & ~F.isnan("measurement_value") & (F.abs("measurement_value") != float("inf"))
    own = {
        "self_loops": (c("source_id") == c("target_id"), False), "missing_endpoints": (c("source_id").isNull() | c("target_id").isNull(), False),
        DUPLICATE: (F.contains(F.coalesce("quality_flag", F.lit("")), F.lit(DUPLICATE)), True), "negative_duration": (c("duration_seconds") < 0, False), "zero_duration": (c("duration_seconds") == 0, True),
        "duration_coordinate_mismatch": (F.abs(c("duration_seconds") - seconds) > 1, True), "reversed_time": (c("end") < c("start"), False), "missing_temporal_coordinates": (no_time, True), "non_finite_measurement": (~finite, True)}
    of_group = {"missing_group_time": (no_time, False), "reversed_group_time": (c("end") < c("start"), False), "negative_group_duration": (c("duration_seconds") < 0, False), "zero_group_duration": (c("duration_seconds") == 0, True)}

    def by_row(df, checks):
        counted = df.agg(every.alias("rows"), *(F.count_if(v).alias(k) for k, (v, _) in checks.items()))
        rows = F.explode(F.array(*(F.struct(F.lit(k).alias("code"), c(k).alias("n"), (c("rows") if share else F.lit(None).cast("long")).alias("rows")) for k, (_, share) in checks.items()))).alias("x")
        return counted.select(rows).select("x.code", "x.n", "x.rows")

    known = who.select("node_id").where("node_id is not null").distinct()
    named = _ends(pairs).select("node_id").where("node_id is not null").distinct()
    listed = members.select("group_event_id").where("group_event_id is not null").distinct()
    n, rows = again(who, "node_id")
    out = _count(n, "duplicate_node_ids", rows, F.sum("c")).union(by_row(who, {"missing_node_ids": (c("node_id").isNull(), False)})).union(by_row(pairs, own)).union(by_row(groups, of_group))
    for df, code, keys in ((pairs, "duplicate_event_ids", ["event_id"]), (groups, "duplicate_group_ids", ["group_event_id"]), (members, "duplicate_group_membership", ["group_event_id", "node_id"])):
        n, rows = again(df, *keys)
        out = out.union(_count(n, code, rows))
    out = out.union(_count(named.join(known, "node_id", "left_anti"), "orphan_dyadic_nodes")).union(_count(listed.join(groups.select("group_event_id"), "group_event_id", "left_anti"), "orphan_group_ids"))
    out = out.union(_count(members.select("node_id").where("node_id is not null").distinct().join(known, "node_id", "left_anti"), "orphan_group_members"))
    weight = {**SEVERITY, "missing_temporal_coordinates": "high" if ds.ordered else "medium"}
    grade = F.create_map(*(F.lit(v) for k in weight.items() for v in k))
    return out.select(grade[c("code")].alias("severity"), "code", "n", (c("n") / F.when(c("rows") > 0, c("rows"))).alias("fraction"))


def _again(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Rows of keys that came before, nulls being alike: counts by key, and what adds them up."""
    return df.groupBy(*keys).agg(F.count("*").alias("c")), F.coalesce(F.sum(F.col("c") - 1), F.lit(0))


def group_sizes(ds: Dataset) -> DataFrame:
    """One row (n, least, median, most, singletons) of the groups' sizes."""
    sizes = ds["group_memberships"].groupBy("group_event_id").agg(F.count("*").alias("s"))
    return sizes.agg(F.count("*").alias("n"), F.min("s").alias("least"), F.percentile("s", F.lit(0.5)).alias("median"), F.max("s").alias("most"), F.avg((F.col("s") == 1).cast("double")).alias("singletons"))


def has_errors(found: DataFrame) -> bool:
    """Whether a check of high or critical weight found anything."""
    return not found.where("n > 0 and severity in ('critical', 'high')").isEmpty()


def require_order(ds: Dataset) -> None:
    """An error where nothing in the dataset has its place in time."""
    if not ds.ordered:
        raise ValueError(f"{ds.dataset_id} has no order in time")
    timed = "start is not null and end is not null"
    if ds["dyadic_events"].where(timed).isEmpty() and ds["group_events"].where(timed).isEmpty():
        raise ValueError(f"{ds.dataset_id} has no event with a place in time")
