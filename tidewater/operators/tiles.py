"""Contact of each two nodes by the groups they share, in tiles of two blocks of nodes.

Nodes are numbered and cut into blocks. A tile's task gets the memberships of its two blocks, packed, and adds up the
contact of their pairs in dense arrays. So no pair is ever shuffled, and each membership is copied once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators.turns import Turns

#: Nodes of a block at most, blocks at least, pairs that a task adds at once, rows that it sends at once, and partitions of tiles.
WIDTH, BLOCKS, ADDED, SENT, DEALT = 2_048, 8, 1 << 21, 1 << 17, 400


@dataclass
class Blocks:
    """Written tables: who (node_id, i, block, pos), flat (g, i, n), packed (block, g, pos, n)."""

    who: DataFrame
    flat: DataFrame
    packed: DataFrame
    width: int
    many: int


def sizes(memberships: DataFrame) -> DataFrame:
    """(group_id, n): groups of two rows or more, two or more of them with a node."""
    return memberships.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"), F.count("node_id").alias("_v")).where("_v >= 2").drop("_v")


def pays(size: DataFrame, nodes: DataFrame) -> bool:
    """Whether copies of memberships are fewer than pairs."""
    x = size.agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
    return x["rows"] is not None and x["pairs"] > x["rows"] * max(BLOCKS, -(-nodes.distinct().count() // WIDTH))


def blocks(turns: Turns, some: DataFrame, size: DataFrame) -> Blocks:
    """The memberships `some` (group_id, node_id) of the groups `size`, in blocks of nodes."""
    some = some.where("node_id is not null").join(size, "group_id")
    who = turns.kept(ranks.numbered(some, "node_id", "i"), "numbers")
    nodes = who.count()
    width = min(WIDTH, max(1, -(-nodes // BLOCKS)))
    block, pos = F.floor((F.col("i") - 1) / width).cast("int").alias("block"), ((F.col("i") - 1) % width).cast("int").alias("pos")
    what = turns.kept(ranks.numbered(size, "group_id", "g"), "groups")
    flat = turns.kept(some.join(what, "group_id").join(who, "node_id").select(F.col("g").cast("int"), "i", F.col("n").cast("int")), "flat")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            b = rows.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]).astype(np.int32)
            if len(b):
                yield pa.record_batch([pa.array(b[cut[:-1]]), *(pa.ListArray.from_arrays(pa.array(cut), rows.column(k)) for k in (1, 2, 3))], ["block", "g", "pos", "n"])

    many = max(1, -(-nodes // width))
    rows = flat.select(block, "g", pos, "n").repartition(min(many, 1_000), "block").sortWithinPartitions("block", "g")
    kept = turns.kept(rows.mapInArrow(packed, "block int, g array<int>, pos array<int>, n array<int>"), "packed")
    return Blocks(who.select("node_id", "i", block, pos), flat, kept, width, many)


def by_block(rows: DataFrame, value: str) -> DataFrame:
    """(block, value): the values of a block's nodes in the order of their places."""
    return rows.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias(value))


def _sums(width: int, added: int, seconds: float, diluted: bool) -> Callable:
    """What adds up a tile: a closure, so that tasks need not have this package."""

    def joined(parts: list) -> list[np.ndarray]:
        """g, pos and n of the chunks of a block, in the order of g."""
        made = [np.concatenate([np.zeros(0, np.int32), *(p[k] for p in parts)]) for k in range(3)]
        order = np.argsort(made[0], kind="stable")
        return [v[order] for v in made]

    def sums(left: list, right: list, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Contact of each node of the left block with each of the right one, and the groups they share."""
        (g, x, n), (h, y, _) = joined(left), joined(right)
        share = seconds / (n - 1.0) if diluted else np.full(len(n), float(seconds))
        start = np.searchsorted(h, g, "left")
        met = np.searchsorted(h, g, "right") - start
        ends = np.concatenate([[0], np.cumsum(met)])
        w, c = np.zeros(width * width), np.zeros(width * width) if counted else None
        first = 0
        while first < len(g):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + added, "right")) - 1)
            many = met[first:last]
            own = np.repeat(np.arange(first, last), many)
            at = np.arange(len(own)) + np.repeat(start[first:last] - ends[first:last] + ends[first], many)
            code = x[own].astype(np.int64) * width + y[at]
            np.add.at(w, code, share[own])
            if counted:
                np.add.at(c, code, np.ones(len(code)))
            first = last
        return w, c

    return sums


def _tiles(held: Blocks, side: DataFrame, value: str, tell: Callable, kinds: str) -> DataFrame:
    """What `tell` says of each tile: `side` (block, value) goes along with the memberships of a block."""
    other = F.explode(F.sequence(F.lit(0), F.lit(held.many - 1))).alias("other")
    none = lambda c: F.lit(None).cast("array<int>").alias(c)
    kind = dict(side.dtypes)[value]
    rows = held.packed.select("block", "g", "pos", "n", F.lit(None).cast(kind).alias(value)).union(side.select("block", none("g"), none("pos"), none("n"), value))
    rows = rows.select("block", other, "g", "pos", "n", value)
    rows = rows.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).alias("second"), "g", "pos", "n", value)

    def told(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = (k.as_py() for k in key)
        parts, sides = ([], []), [None, None]
        for rows in batches:
            second, *lists, values = rows.columns[2:]
            for k, s in enumerate(second.to_pylist()):
                if values[k].is_valid:
                    sides[s] = values[k].values
                else:
                    parts[s].append([v[k].values.to_numpy() for v in lists])
        if p == q:
            parts, sides = (parts[0], parts[0]), [sides[0], sides[0]]
        yield from tell(p, q, *parts, *sides)

    tiles = held.many * (held.many + 1) // 2
    return rows.repartition(min(4 * tiles, max(DEALT, tiles // 16)), "p", "q").groupBy("p", "q").applyInArrow(told, kinds)


def pairs(held: Blocks, seconds: float, diluted: bool) -> DataFrame:
    """(a, b, n_events, contact_seconds) of all pairs."""
    width, sent = held.width, SENT
    sums = _sums(width, ADDED, seconds, diluted)

    def tell(p, q, left, right, names, others):
        w, c = sums(left, right, True)
        met = np.flatnonzero(c)
        if p == q:
            met = met[met // width < met % width]
        for k in range(0, len(met), sent):
            at = met[k: k + sent]
            i, j = np.divmod(at, width)
            yield pa.record_batch([names.take(pa.array(i)), others.take(pa.array(j)), pa.array(c[at].astype(np.int64)), pa.array(w[at])], ["x", "y", "n_events", "contact_seconds"])

    kind = dict(held.who.dtypes)["node_id"]
    made = _tiles(held, by_block(held.who, "node_id"), "node_id", tell, f"x {kind}, y {kind}, n_events long, contact_seconds double")
    return made.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n_events", "contact_seconds")


def gains(held: Blocks, cover: DataFrame, seconds: float) -> DataFrame:
    """(i, gain): by how much the contact of each node is above what others are covered with (i, c), added up over them."""
    width = held.width
    sums = _sums(width, ADDED, seconds, True)

    def tell(p, q, left, right, own, others):
        w = sums(left, right, False)[0].reshape(width, width)
        if p == q:
            np.fill_diagonal(w, 0)
        c, d = own.to_numpy(), others.to_numpy()
        found = [(p, np.maximum(w[: len(c), : len(d)] - d, 0).sum(axis=1))]
        if p != q:
            found.append((q, np.maximum(w[: len(c), : len(d)] - c[:, None], 0).sum(axis=0)))
        yield pa.record_batch([pa.array([b for b, _ in found], pa.int32()), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["block", "gain"])

    side = by_block(held.who.join(cover, "i"), "c")
    made = _tiles(held, side, "c", tell, "block int, gain array<double>")
    i: Column = F.col("block").cast("long") * width + F.col("pos") + 1
    return made.select("block", F.posexplode("gain").alias("pos", "gain")).groupBy(i.alias("i")).agg(F.sum("gain").alias("gain"))
