"""URL filters with dated lists, in DataFrame functions only.

List entries are dated changes ("add" or "remove") of a key: a URL, a host, or a domain that covers
its sub-domains. The changes of a key become validity intervals, half open: an entry holds from its
date until the next change of its key. Each capture is held against the entries in force when it was
fetched: its URL, its host and each domain above it are keys, and an as-of join on key and month
finds the interval that its time lies in. Intervals are cut at months, so a join of a key that
changed often compares few of them, and the rows of a host that holds a third of all captures are
spread over months and may be split further by adaptive execution. Nothing is broadcast.

Defined cases: captures without URL or time match nothing and aren't blocked; entries without key,
date or action are left out, and of several changes of a key at one moment a removal is the last;
rows that repeat are each judged, alike; empty lists block nothing; an empty table gives an empty
result; only the named columns are read, so others don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of keys, the most specific first; a match of several kinds is reported by the first.
KINDS = ("url", "host", "domain")
_DAYS = 30


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a leading "www."; empty where there is none."""
    found = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.regexp_replace(found, r"\.+$", ""), r"^www\.", "")


def key_of(url: Column) -> Column:
    """A URL as it is listed: host, path and query; without scheme, fragment and a slash at the end."""
    rest = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)", 1)
    return F.regexp_replace(F.concat(host_of(url), rest), "/+$", "")


def domains_of(host: Column) -> Column:
    """The host itself and each domain above it with two labels or more; of an address only itself."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.rlike(host, F.lit(r"^[0-9.]+$")) | (F.size(labels) < 2), F.array(host)).otherwise(above)


def intervals(entries: DataFrame, kind: str = "kind", key: str = "key", action: str = "action", at: str = "at") -> DataFrame:
    """(kind, key, valid_from, valid_to) of each entry in force; valid_to is null while it stands."""
    changes = entries.select(
        F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(action).alias("action"), F.col(at).cast("timestamp").alias("valid_from"),
    ).where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & (F.col("key") != "") & F.col("valid_from").isNotNull())
    # one change a moment: the greatest action, so a removal beats an addition
    changes = changes.groupBy("kind", "key", "valid_from").agg(F.max("action").alias("action"))
    following = F.lead("valid_from").over(Window.partitionBy("kind", "key").orderBy("valid_from"))
    return changes.withColumn("valid_to", following).where("action = 'add'").select("kind", "key", "valid_from", "valid_to")


def _month(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / (_DAYS * 86400)).cast("int")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, host, fetched_at, blocked, listed_as, listed_at, n_kinds) of every capture."""
    shots = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched_at"))
    shots = shots.withColumns({"host": host_of(F.col("url")), "row": F.xxhash64("id", "url", "fetched_at")})
    name = lambda kind, key: F.xxhash64(F.lit(kind), key)
    keys = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), name("url", key_of(F.col("url"))).alias("name")), F.struct(F.lit(1).alias("kind"), name("host", F.col("host")).alias("name"))),
        F.transform(domains_of(F.col("host")), lambda d: F.struct(F.lit(2).alias("kind"), name("domain", d).alias("name"))))
    asked = shots.where((F.col("host") != "") & F.col("fetched_at").isNotNull()).select("row", "fetched_at", F.explode(keys).alias("k"))
    asked = asked.select("row", "fetched_at", F.col("k.kind").alias("kind"), F.col("k.name").alias("name"), _month("fetched_at").alias("month"))
    first, last = shots.agg(F.min(_month("fetched_at")), F.max(_month("fetched_at"))).first()
    first, last = (0, -1) if first is None else (first, last)
    held = intervals(entries).select(
        F.xxhash64("kind", "key").alias("name"), "valid_from", "valid_to",
        F.greatest(_month("valid_from"), F.lit(first)).alias("begin"), F.least(F.coalesce(_month("valid_to"), F.lit(last)), F.lit(last)).alias("end"))
    held = held.where("begin <= end").select("name", "valid_from", "valid_to", F.explode(F.sequence("begin", "end")).alias("month"))
    hits = asked.join(held, ["name", "month"]).where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    by_row = hits.groupBy("row").agg(F.min(F.struct("kind", "valid_from")).alias("best"), F.expr("bit_count(bit_or(shiftleft(1, kind)))").alias("n_kinds"))
    found = shots.join(by_row, "row", "left")
    kind = F.get(F.array(*(F.lit(k) for k in KINDS)), F.col("best.kind"))
    return found.select(
        F.col("id").alias(id_col), "host", F.col("fetched_at").alias(time_col), F.col("best").isNotNull().alias("blocked"),
        kind.alias("listed_as"), F.col("best.valid_from").alias("listed_at"), F.coalesce("n_kinds", F.lit(0)).cast("int").alias("n_kinds"))
