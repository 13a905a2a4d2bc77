"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens runs down a tree (by default domain, language, source): each node shares its
budget among its children by weight, a child takes no more than its leaves can give in the allowed
number of epochs, and what it can't take goes to its siblings by their weights. Only when all of them
are full does the rest go back to the parent, and from there to the parent's siblings.

The tree is a table at each level: among siblings in the order of room by weight those that fill up
come first, so running sums tell what each of them gets, and no part of the tree is on the driver.

A leaf gives whole epochs, then a prefix of the next: documents in the seeded order of that epoch
until its tokens are reached; the document that crosses the mark is the last. The order is cut into
bins of about BIN rows by its leading digits, so that only the bin that holds the mark is ever sorted:
a leaf may hold any share of all rows.

Defined cases: null levels are nodes of their own; null text has no tokens and such documents come
with their epoch but cost nothing; null ids have their place by their text; an empty table,
or no budget, gives an empty result; rows that repeat are drawn each; the only columns read are the
levels, id and text, and `mixed` carries all others.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import cut, n_words

#: Rows of a bin, about, and most leading hexadecimal digits of the order that tell bins apart.
BIN, DIGITS = 1000, 8


def allocate(supply: dict[tuple, int], weights: dict[tuple, float], budget: int, epochs: int) -> dict[tuple, int]:
    """Tokens that each leaf gives; weights are by path, 1 where none is given. `allocated` does it for tables of any size."""
    room: dict[tuple, int] = {}
    below: dict[tuple, set] = {}
    for leaf, tokens in supply.items():
        for k in range(len(leaf) + 1):
            room[leaf[:k]] = room.get(leaf[:k], 0) + tokens * epochs
            if k:
                below.setdefault(leaf[: k - 1], set()).add(leaf[:k])
    given: dict[tuple, int] = {}

    def share(node: tuple, amount: Fraction) -> None:
        amount = min(amount, Fraction(room[node]))
        if node not in below:
            given[node] = int(amount)
            return
        active = {c: Fraction(str(weights.get(c, 1))) for c in sorted(below[node], key=str)}
        active = {c: w for c, w in active.items() if w > 0 and room[c] > 0}
        fixed: dict[tuple, Fraction] = {}
        while active:  # children that would overflow are filled; the others share what is left
            each = amount / sum(active.values())
            full = [c for c, w in active.items() if w * each >= room[c]]
            if not full:
                fixed |= {c: w * each for c, w in active.items()}
                break
            for c in full:
                fixed[c] = Fraction(room[c])
                amount -= room[c]
                del active[c]
        for c, v in fixed.items():
            share(c, v)

    if supply:
        share((), Fraction(budget))
    return given


def _key(levels: list[str]) -> Column:
    """The path of a node as one string; null levels are left out, and so unlike all others."""
    return F.to_json(F.struct(*(F.col(c) for c in levels))) if levels else F.lit("")


def allocated(leaves: DataFrame, levels: list[str], weights: dict[tuple, float], budget: float | int, epochs: int) -> DataFrame:
    """Adds `given` to leaves (levels, t): the tokens that each gives of its own, at most t * epochs."""
    spark = leaves.sparkSession
    by_path = spark.createDataFrame([(len(path), [None if p is None else str(p) for p in path], float(w)) for path, w in weights.items()], "depth int, path array<string>, w double")  # a parameter
    share = F.lit(float(budget)) * F.sum("t") if isinstance(budget, float) else F.lit(float(budget))
    given = leaves.agg(F.least(F.floor(share), F.sum("t") * epochs).cast("double").alias("amount")).withColumn("parent", F.lit(""))
    for k in range(1, len(levels) + 1):
        nodes = leaves.groupBy(*levels[:k]).agg((F.sum("t") * epochs).cast("double").alias("room"))
        own = by_path.where(F.col("depth") == k).select("path", "w")
        nodes = nodes.withColumn("path", F.array(*(F.col(c).cast("string") for c in levels[:k]))).join(F.broadcast(own), "path", "left")
        nodes = nodes.select(_key(levels[:k]).alias("node"), _key(levels[: k - 1]).alias("parent"), "room", F.coalesce("w", F.lit(1.0)).alias("w")).where("w > 0 and room > 0")
        order = Window.partitionBy("parent").orderBy(F.col("room") / F.col("w"), "node")
        filled = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.join(given, "parent").withColumn("each", F.greatest(F.lit(0.0), F.col("amount") - filled) / rest)  # for each of weight 1, once those before are full
        full = F.col("w") * F.col("each") >= F.col("room")
        level = F.max(F.when(~full, F.col("each"))).over(Window.partitionBy("parent"))  # null where all are full
        given = nodes.select(F.col("node").alias("parent"), F.least("room", F.coalesce(F.col("w") * level, "room")).alias("amount"))
    at = leaves.withColumn("parent", _key(levels)).join(given, "parent", "left").drop("parent")
    return at.withColumn("given", F.coalesce(F.floor(F.col("amount") + 1e-6), F.lit(0)).cast("long")).drop("amount")


def _order(seed: int, epoch: Column, doc: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.col("tie").cast("string")).cast("binary"))


def _drawn(rows: DataFrame, levels: list[str], weights: dict, budget: float, epochs: int, seed: int) -> DataFrame:
    """rows (doc_id, tokens, levels, ...) with the number of times each is drawn, where not 0."""
    leaves = cut(rows.groupBy(*levels).agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "mixing-leaves")
    plan = allocated(leaves, levels, weights, budget, epochs).where("t > 0 and given > 0")
    digits = F.least(F.lit(DIGITS), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / BIN)))).cast("int")
    plan = plan.select(*(F.col(c).alias(f"leaf_{c}") for c in levels), F.expr("given div t").alias("whole"), (F.col("given") % F.col("t")).alias("mark"), digits.alias("digits"))
    plan = cut(plan, "mixing-plan")
    at = rows.join(plan, [rows[c].eqNullSafe(plan[f"leaf_{c}"]) for c in levels]).drop(*(f"leaf_{c}" for c in levels))
    at = at.withColumn("place", _order(seed, F.col("whole"), "doc_id")).withColumn("bin", F.substring("place", F.lit(1), F.col("digits")))
    bins = at.groupBy(*levels, "bin").agg(F.sum("tokens").alias("in_bin"), F.first("mark").alias("m"))
    before = F.sum("in_bin").over(Window.partitionBy(*levels).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
    # the mark lies in the last bin that begins before it; rows of empty texts may follow at its very place
    edge = bins.where((F.col("before") < F.col("m")) & (F.col("before") + F.col("in_bin") >= F.col("m"))).groupBy(*levels).agg(F.min_by(F.struct("bin", "before"), "bin").alias("e"))
    edge = cut(edge.select(*(F.col(c).alias(f"edge_{c}") for c in levels), F.col("e.bin").alias("edge_bin"), F.col("e.before").alias("edge_before")), "mixing-edges")  # a row a leaf
    at = at.join(edge, [at[c].eqNullSafe(edge[f"edge_{c}"]) for c in levels], "left").drop(*(f"edge_{c}" for c in levels))
    sure = at.where("edge_bin is null or bin <> edge_bin").withColumn("times", F.col("whole") + F.when(F.col("bin") < F.col("edge_bin"), 1).otherwise(0))
    run = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    close = at.where("bin = edge_bin").withColumn("run", F.col("edge_before") + run)
    close = close.withColumn("times", F.col("whole") + F.when(F.col("run") < F.col("mark"), 1).otherwise(0)).drop("run")
    return sure.unionByName(close).where("times > 0").drop("place", "bin", "edge_bin", "edge_before", "whole", "mark", "digits")


def _rows(docs: DataFrame, levels: list[tuple[str, Column]], id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("tokens"), F.xxhash64(text_col).alias("tie"),
        *(c.alias(name) for name, c in levels))


def mix(docs: DataFrame, levels: list[tuple[str, Column]], weights: dict, budget: float | int, epochs: int = 1, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, levels, tokens, times) of each row that is drawn; a float budget is a share of all tokens."""
    return _drawn(_rows(docs, levels, id_col, text_col), [n for n, _ in levels], weights, budget, epochs, seed).drop("tie")


def mixed(docs: DataFrame, levels: list[tuple[str, Column]], weights: dict, budget: float | int, epochs: int = 1, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are drawn, as often as they are, with all their columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("tokens"), F.xxhash64(text_col).alias("tie"),
        *(c.alias(name) for name, c in levels), whole)
    drawn = _drawn(rows, [n for n, _ in levels], weights, budget, epochs, seed)
    if epochs > 1:
        drawn = drawn.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return drawn.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def by_source(source: str = "source", lang: str = "lang") -> list[tuple[str, Column]]:
    """Domain, language, source: the domain is the source's number modulo 4."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return [("domain", F.when(number == "", "none").otherwise(F.concat(F.lit("domain"), (number.try_cast("int") % 4).cast("string")))), ("lang", F.col(lang)), ("source", F.col(source))]
