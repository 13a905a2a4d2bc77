"""Factorial parts of variance, retention of edge sets, subsets of small pools and rings of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import ranks
from tidewater.operators.policies import hash_order


def factorial_parts(cells: DataFrame, by: list[str], family: str, factors: dict[str, Column], outcome: str) -> DataFrame:
    """(by, component, sum_squares, share, balanced): a family * 2 ** k table taken apart.

    Components are "family", each factor, each interaction ("a x b"), and "residual", which isn't below 0. A table is
    balanced if each of its families has one row with a value for each setting of the factors; else its sums are null.
    One aggregation by family and one of those hold all contrasts, since they are sums of the outcome with signs.
    """
    names = list(factors)
    signs = {n: F.when(c, 1.0).otherwise(-1.0) for n, c in factors.items()}
    terms = {}
    for mask in range(1, 1 << len(names)):
        of = [n for k, n in enumerate(names) if mask >> k & 1]
        sign = F.lit(1.0)
        for n in of:
            sign = sign * signs[n]
        terms[" x ".join(of)] = sign
    some = cells.where(F.col(outcome).isNotNull())
    y = F.col(outcome).cast("double")
    setting = F.concat(*(F.when(c, "1").otherwise("0") for c in factors.values()))
    each = some.groupBy(*by, family).agg(
        F.count("*").alias("n"), F.countDistinct(setting).alias("d"), F.sum(y).alias("s"), F.sum(y * y).alias("q"), *(F.sum(y * t).alias(f"c{k}") for k, t in enumerate(terms.values())))
    per = 1 << len(names)
    n = F.sum("n")
    whole = each.groupBy(*by).agg(
        ((F.min("n") == per) & (F.max("n") == per) & (F.min("d") == per)).alias("balanced"), n.alias("n"), (F.sum("q") - F.sum("s") ** 2 / n).alias("total"),
        (F.sum(F.col("s") ** 2) / per - F.sum("s") ** 2 / n).alias("family"), *((F.sum(f"c{k}") ** 2 / n).alias(f"c{k}") for k in range(len(terms))))
    explained = F.col("family")
    for k in range(len(terms)):
        explained = explained + F.col(f"c{k}")
    parts = [("family", F.col("family")), *((t, F.col(f"c{k}")) for k, t in enumerate(terms)), ("residual", F.greatest(F.col("total") - explained, F.lit(0.0)))]
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("component"), v.alias("ss")) for t, v in parts))).alias("x")
    found = whole.select(*by, "balanced", "total", rows)
    ss = F.when(F.col("balanced"), F.col("x.ss"))
    return found.select(*by, F.col("x.component").alias("component"), ss.alias("sum_squares"), F.when(F.col("balanced"), F.when(F.col("total") > 0, F.col("x.ss") / F.col("total")).otherwise(0.0)).alias("share"), "balanced")


def retention(left: DataFrame, right: DataFrame, nodes: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """One row for each context of `nodes` (by, node): how two sets of weighted edges (by, a, b, w) resemble each other.

    `adjusted` is the overlap beyond chance over the greatest possible one, 0 and not `estimable` where the sets leave no
    room for it. Edges meet in one full join; nodes without edges count in ranks and in the top `fraction`.
    """
    edge = [*by, "a", "b"]
    both = left.select(*edge, F.col("w").alias("l")).join(right.select(*edge, F.col("w").alias("r")), edge, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = both.groupBy(*by).agg(
        F.count("l").alias("left_edges"), F.count("r").alias("right_edges"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count("*").alias("union"),
        F.sum(zero("l") * zero("r")).alias("dot"), F.sum(zero("l") ** 2).alias("ll"), F.sum(zero("r") ** 2).alias("rr"), F.sum(zero("l")).alias("left_weight"), F.sum(zero("r")).alias("right_weight"))
    ends = both.select(*by, F.explode(F.array("a", "b")).alias("node"), zero("l").alias("l"), zero("r").alias("r")).groupBy(*by, "node").agg(F.round(F.sum("l"), 9).alias("l"), F.round(F.sum("r"), 9).alias("r"))  # sums that differ by their order are ties
    held = nodes.select(*by, "node").distinct().join(ends, [*by, "node"], "left").withColumns({"l": zero("l"), "r": zero("r")})
    ranked = ranks.average_rank(ranks.average_rank(held, "l", by, "lr"), "r", by, "rr")
    of = Window.partitionBy(*by)
    place = lambda v: F.row_number().over(of.orderBy(F.desc(v), "node"))
    ranked = ranked.withColumns({"n": F.count("*").over(of), "lp": place("l"), "rp": place("r")}).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * fraction)))
    of_nodes = ranked.groupBy(*by).agg(F.max("n").alias("n"), F.max("k").alias("k"), F.coalesce(ranks.correlation("lr", "rr"), F.lit(0.0)).alias("rank_persistence"), F.count_if((F.col("lp") <= F.col("k")) & (F.col("rp") <= F.col("k"))).alias("top"))
    x = of_nodes.join(sums, by, "left").na.fill(0)
    possible = F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(possible > 0, F.col("left_edges") * F.col("right_edges") / possible).otherwise(0.0)
    room = F.least("left_edges", "right_edges") - expected
    norm = F.sqrt(F.col("ll")) * F.sqrt(F.col("rr"))
    return x.select(
        *by, "n", F.when(room > 1e-12, (F.col("shared") - expected) / room).otherwise(0.0).alias("adjusted"), (room > 1e-12).alias("estimable"),
        F.when(F.col("union") > 0, F.col("shared") / F.col("union")).otherwise(1.0).alias("jaccard"), F.when(norm > 0, F.col("dot") / norm).otherwise(0.0).alias("cosine"),
        "rank_persistence", (F.col("top") / F.col("k")).alias("top_overlap"), "left_edges", "right_edges", "shared", "left_weight", "right_weight")


def subsets(pools: DataFrame, by: list[str], item: str, budget: int, most: int = 16) -> DataFrame:
    """(by, mask, size, items): every subset of up to `budget` items of each pool (by, item), the empty one too.

    Bit k of a mask stands for the k-th item in their order. Pools of more than `most` items raise an error.
    """
    held = pools.where(F.col(item).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_set(item)).alias("pool"))  # of `most` items at most, by contract
    n = F.size("pool")
    checked = F.when(n <= most, n).otherwise(F.raise_error(F.concat(F.lit(f"a pool has more than {most} items: "), n.cast("string"))).cast("int"))
    masks = held.select(*by, "pool", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), checked).cast("long") - 1)).alias("mask"))
    size = F.bit_count("mask").cast("int")
    chosen = F.filter("pool", lambda v, i: F.col("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0)
    return masks.where(size <= budget).select(*by, "mask", size.alias("size"), chosen.alias("items"))


def extensions(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, mask, added, bigger): each subset and those with one item more."""
    big = sets.where("size > 0").select(*by, F.col("mask").alias("bigger"), F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda b: F.col("mask").bitwiseAND(b) != 0)).alias("added"))
    return big.select(*by, (F.col("bigger") - F.col("added")).alias("mask"), "added", "bigger")


def violations(values: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, inequalities, replicated, rate, mean_margin): where gains grow in both halves of the blocks.

    `values` are (by, block, mask, value) and `pairs` the sets (by, mask, size) that were asked for. For each item x and each
    other item b, the gain of x alone is held against that of x beside b; blocks are halved by their order, a set without
    a value in a half counts as 0 there. `rate` is null where no set of two was asked for.
    """
    blocks = Window.partitionBy(*by).orderBy("block")
    halves = values.select(*by, "block").distinct().withColumn("i", F.row_number().over(blocks) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    halves = halves.select(*by, "block", (F.col("i") >= F.floor(F.col("n") / 2)).cast("int").alias("half"))
    mean = values.join(halves, [*by, "block"]).groupBy(*by, "mask").agg(*(F.coalesce(F.avg(F.when(F.col("half") == h, F.col("value"))), F.lit(0.0)).alias(f"v{h}") for h in (0, 1)))
    asked = pairs.select(*by, "mask", "size").join(mean, [*by, "mask"], "left").na.fill(0.0, ["v0", "v1"])
    two = extensions(asked.where("size = 2").select(*by, "mask", "size"), by).select(*by, F.col("mask").alias("other"), F.col("added").alias("x"), "bigger")
    of = lambda name, key: asked.select(*by, F.col("mask").alias(key), F.col("v0").alias(f"{name}0"), F.col("v1").alias(f"{name}1"))
    none = asked.where("size = 0").select(*by, F.col("v0").alias("e0"), F.col("v1").alias("e1"))
    both = two.join(of("b", "other"), [*by, "other"]).join(of("a", "x"), [*by, "x"]).join(of("c", "bigger"), [*by, "bigger"]).join(none, by)
    margin = {h: (F.col(f"a{h}") - F.col(f"e{h}")) - (F.col(f"c{h}") - F.col(f"b{h}")) for h in (0, 1)}
    hit = (margin[0] < 0) & (margin[1] < 0)
    found = both.groupBy(*by).agg(F.count("*").alias("inequalities"), F.count_if(hit).alias("replicated"), F.coalesce(F.avg(F.when(hit, (margin[0] + margin[1]) / 2)), F.lit(0.0)).alias("mean_margin"))
    out = pairs.select(*by).distinct().join(found, by, "left").na.fill(0, ["inequalities", "replicated"])
    return out.select(*by, "inequalities", "replicated", F.when(F.col("inequalities") > 0, F.col("replicated") / F.col("inequalities")).alias("rate"), "mean_margin")


def case_rings(contacts: DataFrame, eligible: DataFrame, cases: DataFrame, by: list[str], methods: dict[str, str], budget: int, seed: int) -> DataFrame:
    """(by, case, method, node, position): the ring of each case (by, case), for all contexts, cases and methods at once.

    `contacts` are (by, node, partner, a score for each method), `eligible` are (by, node, stable). Contacts of a case come
    first, by their score; then come those who are best by `stable`, ties by a hash. Only a case's contacts and as many of the
    context's best as could ever be asked for are ranked, so there is no row for each case and node.
    """
    tie = lambda m: hash_order(F.col("node"), seed, m, "ties")
    out = None
    for method, score in methods.items():
        near = contacts.where(F.col(score) > 0).select(*by, F.col("node").alias("case"), F.col("partner").alias("node"), F.col(score).alias("score"))
        near = near.join(cases.select(*by, "case"), [*by, "case"], "left_semi").join(eligible.select(*by, "node", "stable"), [*by, "node"]).where("node <> case")
        near = near.withColumn("position", F.row_number().over(Window.partitionBy(*by, "case").orderBy(F.desc("score"), F.desc("stable"), tie(method), "node"))).where(F.col("position") <= budget)
        best = eligible.withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("stable"), tie(method), "node"))).where(F.col("p") <= 2 * budget + 1)
        kept = near.groupBy(*by, "case").agg(F.count("*").alias("held"), F.collect_list("node").alias("ring"))  # `budget` nodes at most
        open_ = cases.select(*by, "case").join(kept, [*by, "case"], "left").withColumn("held", F.coalesce("held", F.lit(0))).where(F.col("held") < budget)
        fill = open_.join(best.select(*by, "node", "stable"), by).where((F.col("node") != F.col("case")) & ~F.coalesce(F.array_contains("ring", F.col("node")), F.lit(False)))
        fill = fill.withColumn("position", F.col("held") + F.row_number().over(Window.partitionBy(*by, "case").orderBy(F.desc("stable"), tie(method), "node"))).where(F.col("position") <= budget)
        one = near.select(*by, "case", "node", "position").union(fill.select(*by, "case", "node", "position")).select(*by, "case", F.lit(method).alias("method"), "node", F.col("position").cast("int").alias("position"))
        out = one if out is None else out.union(one)
    return out
