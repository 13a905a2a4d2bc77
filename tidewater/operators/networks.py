"""Measures of contact networks: a turn is a product with the matrix of edges in blocks, or one join on the node and one aggregation.

Edges are (by, node, partner, w), both ways, without loops; all contexts `by` advance together. Turns go on until nothing
changes any more, or less than a tolerance, and every few turns are written to the shared folder, where the lineage ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import blocks
from tidewater.operators.turns import Turns

#: Turns between two written tables.
EVERY = 4


def both_ways(pairs: DataFrame, a: str, b: str, w: Column, *keys: str) -> DataFrame:
    """(keys, node, partner, w): each pair from both of its ends; pairs of a node with itself and null ends are left out."""
    some = pairs.where(F.col(a) != F.col(b))
    ends = F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("partner")), F.struct(F.col(b).alias("node"), F.col(a).alias("partner")))).alias("x")
    return some.select(*keys, ends, w.alias("w")).select(*keys, "x.node", "x.partner", "w")


def _edges_of(edges: DataFrame, place: DataFrame, by: list[str], weight: Column, *of_node: str) -> DataFrame:
    """Edges between places of blocks; `weight` may name columns `of_node` of the node's place."""
    ends = edges.join(place.select(*by, "node", F.col("block").alias("j"), F.col("pos").alias("s"), *of_node), [*by, "node"])
    ends = ends.select(*by, F.col("partner").alias("node"), "j", "s", weight.alias("w"))
    return ends.join(place.select(*by, "node", F.col("block").alias("i"), F.col("pos").alias("t")), [*by, "node"]).select("j", "s", "i", "t", "w")


def _settled(new: DataFrame, info: DataFrame, by: list[str], tolerance: float) -> bool:
    """Whether every context changes by less than `tolerance` a node, in all; `new` has the change `e` of each block."""
    change = new.select("block", "e").join(info, "block").groupBy(*by).agg(F.sum("e").alias("e"), F.max("n").alias("n"))
    return change.where(F.col("e") >= F.col("n") * tolerance).isEmpty()


def _info(turns: Turns, place: DataFrame, by: list[str], lost: Column) -> DataFrame:
    """(by, block, size, n, lost): a row a block, with the nodes of its context and the places `lost`."""
    each = place.groupBy(*by, "block").agg(F.count("*").alias("size"), F.collect_list(F.when(lost, F.col("pos"))).alias("lost"))
    sizes = each.groupBy(*by).agg(F.sum("size").alias("n"))
    return turns.kept(each.join(sizes, by) if by else each.crossJoin(F.broadcast(sizes)), "info")  # one row


def pagerank(edges: DataFrame, by: list[str], nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """(by, node, rank): weighted PageRank to a tolerance a node; an error if `most` turns don't reach it.

    `nodes` (by, node) may name nodes without edges: what they hold goes to all nodes alike.
    """
    turns = Turns(edges.sparkSession)
    ends = edges.groupBy(*by, "node").agg(F.sum("w").alias("sum")).where("sum > 0")
    every = (ends.select(*by, "node") if nodes is None else nodes.select(*by, "node").union(ends.select(*by, "node"))).distinct()
    place = turns.kept(blocks.placed(every, by).join(ends, [*by, "node"], "left"), "place")
    info = _info(turns, place, by, F.col("sum").isNull())
    dangling = not place.where("sum is null").isEmpty()
    held = blocks.chunks(_edges_of(edges, place.where("sum is not null"), by, F.col("w") / F.col("sum"), "sum"))
    rank = turns.kept(info.select("block", F.transform(F.sequence(F.lit(1), F.col("size").cast("int")), lambda _: 1 / F.col("n")).alias("x")), "rank")
    try:
        for turn in range(EVERY, most + EVERY, EVERY):
            new = rank
            for _ in range(EVERY):
                base = F.lit(1 - damping)
                if dangling:  # what a turn loses is read from its table, so that one is written
                    new = turns.kept(new, "turn")
                flow = blocks.product(held, new).join(info, "block")
                if dangling:
                    of = new.join(info, "block").select(*by, F.aggregate(F.transform("lost", lambda p: F.get("x", p)), F.lit(0.0), lambda s, v: s + v).alias("v")).groupBy(*by).agg(F.sum("v").alias("v"))
                    flow = flow.join(of, by) if by else flow.crossJoin(F.broadcast(of))  # one row
                    base = base + damping * F.col("v")
                new = flow.withColumn("base", base / F.col("n")).select("block", F.transform("y", lambda v: F.col("base") + damping * v).alias("x"))
            new = new.join(rank.select("block", F.col("x").alias("old")), "block")
            rank = turns.kept(new.select("block", "x", blocks.apart("x", "old").alias("e")), "rank")
            if _settled(rank, info, by, tolerance):
                turns.drop("turn")
                return blocks.spread(rank, place, by, "rank")
            rank = rank.drop("e")
    finally:
        held.unpersist()
    raise RuntimeError(f"PageRank changes by more than {tolerance} a node after {most} turns")


def eigenvector(edges: DataFrame, by: list[str], tolerance: float = 1e-10, most: int = 2000) -> DataFrame:
    """(by, node, score): the leading eigenvector, of length 1, by power iteration of the weights plus the identity.

    Weights are divided by the largest of their context. An error if `most` turns don't reach the tolerance.
    """
    turns = Turns(edges.sparkSession)
    join = lambda x, y: x.join(y, by) if by else x.crossJoin(F.broadcast(y))  # noqa: E731  one row
    top = edges.groupBy(*by).agg(F.max("w").alias("top"))
    place = turns.kept(join(blocks.placed(edges.select(*by, "node").distinct(), by), top), "place")
    info = _info(turns, place, by, F.lit(False))
    held = blocks.chunks(_edges_of(edges, place, by, F.col("w") / F.col("top"), "top"))
    score = turns.kept(info.select("block", F.transform(F.sequence(F.lit(1), F.col("size").cast("int")), lambda _: 1 / F.sqrt("n")).alias("x")), "score")
    try:
        for turn in range(EVERY, most + EVERY, EVERY):
            new = score
            for _ in range(EVERY):
                new = blocks.product(held, new).select("block", F.zip_with("x", "y", lambda a, b: a + b).alias("x"))
            new = turns.kept(new.select("block", "x", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("square")), "turn").join(info.select(*by, "block"), "block")
            new = join(new, new.groupBy(*by).agg(F.sqrt(F.sum("square")).alias("l"))).select("block", F.transform("x", lambda v: v / F.col("l")).alias("x"))
            new = new.join(score.select("block", F.col("x").alias("old")), "block")
            score = turns.kept(new.select("block", "x", blocks.apart("x", "old").alias("e")), "score")
            if _settled(score, info, by, tolerance):
                turns.drop("turn")
                return blocks.spread(score, place, by, "score")
            score = score.drop("e")
    finally:
        held.unpersist()
    raise RuntimeError(f"the eigenvector changes by more than {tolerance} a node after {most} turns")


def k_core(edges: DataFrame) -> DataFrame:
    """(node, core): core numbers, as the fixed point of "the most h neighbours that have h or more", from the degrees.

    A chain of n nodes takes n / 2 turns; there is no limit to them.
    """
    turns = Turns(edges.sparkSession)
    plain = turns.kept(edges.select("node", "partner").distinct(), "plain")
    core = turns.kept(plain.groupBy("node").agg(F.count("*").alias("core")), "core")
    upto = F.sum("c").over(Window.partitionBy("node").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0))
    while True:
        new = core
        for _ in range(EVERY):
            near = plain.join(new.select(F.col("node").alias("partner"), "core"), "partner").groupBy("node", "core").agg(F.count("*").alias("c"))
            less = near.withColumn("upto", upto).groupBy("node").agg(F.max(F.least("core", "upto")).alias("core"))
            new = less
        new = turns.kept(new.join(core.withColumnRenamed("core", "old"), "node"), "core")
        core = new.select("node", "core")
        if new.where("core < old").isEmpty():
            turns.drop("plain")
            return core
