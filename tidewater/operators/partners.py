"""How many different others each node met, counted in tiles of nodes and partners.

A tile holds the memberships of a block of nodes and of PIECE partners. Its task sets one bit for each member of a
large group and merges the maps of a node's groups there, so that no map is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partners in a tile, tiles at least, and rows of maps that are merged at once.
PIECE, TILES, MERGED = 32_768, 24, 8_192
#: Groups up to this size give their partners as pairs, so that a task holds at most 32 bytes of maps a membership.
PAIRED = 128


def _counter(width: int, merged: int) -> Callable:
    """What counts a tile: a closure, so that tasks need not have this package."""

    def bits(rows: np.ndarray, bit: np.ndarray, many: int) -> np.ndarray:
        """Maps (many, width / 64) with the given bits set."""
        made = np.zeros((many, width // 64), np.uint64)
        np.bitwise_or.at(made, (rows, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return made

    def counts(left: pd.DataFrame, right: pd.DataFrame, piece: int) -> Iterator[pd.DataFrame]:
        """(i, partners, fit) of a tile; see `partner_counts`."""
        g, j = left["g"].to_numpy(), left["j"].to_numpy() % width
        fit = bits(np.zeros(int((g < 0).sum()), np.int64), j[g < 0], 1)[0]
        groups, at = np.unique(g[g >= 0], return_inverse=True)
        maps = np.concatenate([bits(at, j[g >= 0], len(groups)), np.zeros((1, width // 64), np.uint64)])
        right = right.sort_values("i", kind="stable")
        i, g, j = (right[c].to_numpy() for c in ("i", "g", "j"))
        place = np.searchsorted(groups, g)
        hit = np.zeros(len(g), bool) if not len(groups) else (g >= 0) & (groups[np.minimum(place, len(groups) - 1)] == g)
        place = np.where(hit, place, len(groups))
        nodes, start = np.unique(i, return_index=True)
        ends = np.append(start, len(i))
        first = 0
        while first < len(nodes):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + merged, "right")) - 1)
            a, b = ends[first], ends[last]
            met = np.bitwise_or.reduceat(maps[place[a:b]], start[first:last] - a, axis=0)
            own = np.repeat(np.arange(last - first), np.diff(ends[first: last + 1]))
            pair = np.flatnonzero(g[a:b] < 0)
            bit = j[a:b][pair] % width
            np.bitwise_or.at(met, (own[pair], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            itself = np.flatnonzero(nodes[first:last] // width == piece)
            bit = nodes[first:last][itself] % width
            met[itself, bit >> 6] &= ~(np.uint64(1) << (bit & 63).astype(np.uint64))
            yield pd.DataFrame({"i": nodes[first:last], "partners": np.bitwise_count(met).sum(1, dtype=np.int64), "fit": np.bitwise_count(met & fit).sum(1, dtype=np.int64)})
            first = last

    return counts


def partner_counts(members: DataFrame, fit: DataFrame, by: list[str], nodes: int, paired: int | None = None) -> DataFrame:
    """(by, i, partners, fit): the others that each node met, and those of them in `fit` (by, i).

    `members` are (by, g, i, n): group and node as numbers, each row once, and the size of the group, 2 or more. Nodes are
    numbered from 1 to `nodes` without gaps. Groups up to `paired` (PAIRED) meet as pairs, larger ones in tiles.
    """
    paired = PAIRED if paired is None else paired
    pieces = nodes // PIECE + 1
    blocks = max(pieces, -(-TILES // pieces))
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    piece = lambda c: F.floor(F.col(c) / PIECE).cast("int").alias("p")
    large, small = members.where(F.col("n") > paired), members.where(F.col("n") <= paired)
    pairs = small.select(*by, "g", "i").join(small.select(*by, "g", F.col("i").alias("j")), [*by, "g"]).where("i <> j").select(*by, "i", "j").distinct()
    none = F.lit(-1).cast("long")
    left = large.select(*by, "g", F.col("i").alias("j")).union(fit.select(*by, none, "i")).select(*by, piece("j"), each(blocks, "b"), "g", "j")
    right = large.select(*by, each(pieces, "p"), block.alias("b"), "g", "i", none.alias("j")).union(pairs.select(*by, piece("j"), block.alias("b"), none, "i", "j"))
    key = [*by, "p", "b"]
    counts = _counter(PIECE, MERGED)

    def counted(key, a, b):
        made = pd.concat([*counts(a, b, key[-2]), pd.DataFrame({"i": [], "partners": [], "fit": []}, dtype="int64")])
        for k, c in enumerate(by):
            made[c] = key[k]
        return made[[*by, "i", "partners", "fit"]]

    kinds = ", ".join(f"`{c}` {t}" for c, t in members.select(*by).dtypes) + (", " if by else "")
    tiles = left.toDF(*key, "g", "j").groupBy(*key).cogroup(right.toDF(*key, "g", "i", "j").groupBy(*key)).applyInPandas(counted, f"{kinds}i long, partners long, fit long")
    return tiles.groupBy(*by, "i").agg(F.sum("partners").alias("partners"), F.sum("fit").alias("fit"))
