"""Range sharding by sampled splitters, in DataFrame functions only.

The order of records is that of key, checksum and size, and among records alike in all three that of
a salt, so that no key is too large to be cut: one that holds a third of all rows, or the null key,
is many ranges like any other stretch of the order. Points of that order are sampled with a chance
that grows with the size of their record, the quantiles of the sample bound the ranges, and records go
to ranges by binary search among the bounds. Ranges that turn out overfull are sampled again, more
densely, and cut. With the exact bytes of every range known, each record's place in the whole order
follows from its place in its range; shard s takes the records whose middle byte lies in the s-th
part of all bytes. So shards differ by less than one record at either end, however far the sample was
off.

The driver holds the bounds and one row a range: a range has up to RANGE_ROWS rows, so 10 ** 12 rows
have 500,000 ranges. They go to the tasks as broadcast tables, not as parts of a plan.

Defined cases: null text has 0 bytes and the checksum of an empty one; null keys come first; rows
with equal keys are ordered by checksum and size, and equal rows are alike; an empty table gives an
empty result; columns besides key and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import cut

#: Rows that a range should have at most, ranges for each shard at least, and sampled keys for each range.
RANGE_ROWS, RANGES, SAMPLED = 2_000_000, 8, 64
#: A range is overfull beyond this many times its share.
OVERFULL = 2
LEAST = -(1 << 63)


POINT = ["key", "tie", "salt"]


def _ranged(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Adds range_id: how many bounds are not above the record's point, by binary search."""
    if not bounds:
        return rows.withColumn("range_id", F.lit(0))
    kind = "array<struct<key:bigint,tie:bigint,salt:bigint>>"
    one = rows.sparkSession.createDataFrame([(bounds,)], f"bounds {kind}")  # bounded by the number of ranges
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    at = F.aggregate(
        F.array(*(F.lit(v) for v in steps)), F.lit(0),
        lambda a, v: F.when((a + v <= len(bounds)) & (F.get("bounds", a + v - 1) <= F.struct(*POINT)), a + v).otherwise(a))
    return rows.crossJoin(F.broadcast(one)).withColumn("range_id", at).drop("bounds")  # one row


def _quantiles(points: list[tuple], n: int) -> set[tuple]:
    points = sorted(points)
    return {points[len(points) * k // n] for k in range(1, n)} if points else set()


def ranges(rows: DataFrame, n_shards: int, seed: int, range_rows: int = RANGE_ROWS) -> tuple[list[tuple], int]:
    """The bounds of the ranges of rows (key, tie, salt, size), and the sum of all sizes."""
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return [], 0
    many = max(n_shards * RANGES, -(-n // range_rows))
    chance = lambda turn: F.pmod(F.xxhash64(*POINT, F.lit(seed + turn)), F.lit(1 << 40)) / float(1 << 40)
    rate = many * SAMPLED / total
    got = [tuple(r) for r in rows.where(chance(0) < F.col("size") * rate).select(*POINT).collect()]  # about `many * SAMPLED` points
    bounds = _quantiles(got, many)
    for turn in (1, 2, 3):
        at = _ranged(rows, sorted(bounds))
        over = at.groupBy("range_id").agg(F.sum("size").alias("b")).where(F.col("b") > OVERFULL * total / many).select("range_id")  # at most many / OVERFULL
        rate *= 4
        more: dict[int, list[tuple]] = {}
        for r in at.join(F.broadcast(over), "range_id").where(chance(turn) < F.col("size") * rate).select("range_id", *POINT).collect():
            more.setdefault(r[0], []).append(tuple(r)[1:])
        new = bounds | {q for points in more.values() for q in _quantiles(points, max(2, -(-len(points) // (SAMPLED * 4))))}
        if new == bounds:
            break
        bounds = new
    return sorted(bounds), total


def shard_by_bytes(docs: DataFrame, n_shards: int, key_col: str = "doc_id", text_col: str = "text", seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, range_id) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(key_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # rows that are alike in all else may change places from one reading to the next: their salts are written down
    rows = cut(rows.withColumns({"key": F.coalesce("doc_id", F.lit(LEAST)), "tie": F.col("text_crc32") * (1 << 31) + F.col("size"), "salt": F.xxhash64(F.monotonically_increasing_id())}), "shard-rows")
    bounds, total = ranges(rows, n_shards, seed, range_rows)
    placed = _ranged(rows, bounds)
    sizes = placed.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    heads = sizes.select("range_id", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first_byte"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"))
    inside = Window.partitionBy("range_id").orderBy(*POINT)
    placed = placed.withColumns({
        "start": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "place": F.row_number().over(inside) - 1})
    placed = placed.join(F.broadcast(heads), "range_id").withColumns({"start": F.col("start") + F.col("first_byte"), "place": F.col("place") + F.col("first_row")})
    shard = F.least(F.lit(n_shards - 1), F.expr(f"((2 * start + size) * {n_shards}L) div {max(1, 2 * total)}L")).cast("int")
    placed = cut(placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", "place", "range_id"), "shard-places")
    head = placed.groupBy("shard").agg(F.min("place").alias("head"))  # one row a shard
    return placed.join(F.broadcast(head), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("head")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "range_id")
