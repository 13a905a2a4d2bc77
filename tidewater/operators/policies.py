"""Evaluation of scores and choice of targets within contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import ranks
from tidewater.operators import exposure, tiles
from tidewater.operators.turns import Turns


def _taken(groups: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Adds `name`: the share of each group of ties (by, order, _c) among the first k of its context."""
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") - before) / F.col("_c"))))


def evaluate_scores(df: DataFrame, by: list[str], value: str, scores: list[str], fraction: float) -> DataFrame:
    """One row for each context and score: what the top `fraction` by that score is worth.

    Ties share the places that are left, so results are expectations over the order of ties. A score
    named "random" stands for the expectation of a random choice. Rows are counted by score first:
    only distinct scores are ordered. Rows without a value are left out.
    """
    df = df.where(F.col(value).isNotNull())
    size = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("random_value")).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * fraction)).cast("int"))
    oracle = _taken(df.groupBy(*by, value).agg(F.count("*").alias("_c")).join(size, by), by, value, "in_oracle")
    best = oracle.groupBy(*by).agg((F.sum(F.col("in_oracle") * F.col("_c") * F.col(value)) / F.max("k")).alias("oracle_value"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("method"), (F.col(s) if s != "random" else F.lit(0.0)).cast("double").alias("score")) for s in scores))).alias("x")
    rows = df.join(oracle.select(*by, value, "in_oracle"), [*by, value]).select(*by, value, "in_oracle", each).select(*by, value, "in_oracle", "x.method", "x.score")
    tied = rows.groupBy(*by, "method", "score").agg(F.count("*").alias("_c"), F.sum(value).alias("_v"), F.sum("in_oracle").alias("_o")).join(size.select(*by, "k"), by)
    tied = _taken(tied, [*by, "method"], "score", "share")
    out = tied.groupBy(*by, "method").agg((F.sum(F.col("share") * F.col("_v")) / F.max("k")).alias("selected_value"), (F.sum(F.col("share") * F.col("_o")) / F.max("k")).alias("overlap"), F.count("*").alias("n_scores"))
    rho = ranks.spearman(rows, "score", value, [*by, "method"]).select(*by, "method", "spearman")
    out = out.join(rho, [*by, "method"]).join(size, by).join(best, by)
    gain = F.col("oracle_value") - F.col("random_value")
    return out.select(
        *by, "method", "n", "k", F.coalesce("spearman", F.lit(0.0)).alias("spearman"), "n_scores", "selected_value", "oracle_value", "random_value",
        F.when(gain > 1e-15, (F.col("selected_value") - F.col("random_value")) / gain).alias("capture"), (F.col("oracle_value") - F.col("selected_value")).alias("regret"), "overlap")


def rank_stability(df: DataFrame, context: str, item: str, value: str, k: int, by: list[str] | None = None) -> DataFrame:
    """One row for each two contexts (of a group `by`) with two items or more in common, compared on those.

    The join is on the item, so it makes a row for each item and pair of contexts that hold it.
    """
    by = by or []
    one = df.select(*by, F.col(context).alias("left"), F.col(item).alias("item"), F.col(value).cast("double").alias("lv"))
    x = one.join(one.toDF(*by, "right", "item", "rv"), [*by, "item"]).where(F.col("left") < F.col("right"))
    pair = [*by, "left", "right"]
    x = ranks.average_rank(ranks.average_rank(x, "lv", pair, "lr"), "rv", pair, "rr")
    place = lambda v: F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc(v), "item"))
    x = x.withColumns({"lt": place("lv") <= k, "rt": place("rv") <= k})
    x = x.groupBy(*pair).agg(
        F.count("*").alias("shared"), ranks.correlation("lr", "rr").alias("spearman"), F.count_if(F.col("lt") & F.col("rt")).alias("overlap"), F.count_if(F.col("lt") | F.col("rt")).alias("either"),
        F.avg(F.when(F.col("lt"), F.col("lv"))).alias("l_best"), F.avg(F.when(F.col("rt"), F.col("rv"))).alias("r_best"),
        F.avg(F.when(F.col("lt"), F.col("rv"))).alias("r_by_l"), F.avg(F.when(F.col("rt"), F.col("lv"))).alias("l_by_r")).where("shared >= 2")
    kept = lambda v, best: F.when(F.col(best) > 0, F.col(v) / F.col(best))
    return x.select(
        *pair, "shared", "spearman", F.least(F.lit(k), "shared").cast("int").alias("k"), "overlap", (F.col("overlap") / F.least(F.lit(k), "shared")).alias("overlap_fraction"),
        (F.col("overlap") / F.col("either")).alias("jaccard"), kept("r_by_l", "r_best").alias("left_to_right"), kept("l_by_r", "l_best").alias("right_to_left"),
        ((kept("r_by_l", "r_best") + kept("l_by_r", "l_best")) / 2).alias("retention"), ((F.col("r_best") - F.col("r_by_l") + F.col("l_best") - F.col("l_by_r")) / 2).alias("regret"))


def hash_order(value: Column, *key: Column | str | int) -> Column:
    """A key that orders values as if at random, the same way for the same key."""
    return F.sha2(F.concat_ws("\x1f", *(F.lit(str(k)) if not isinstance(k, Column) else k.cast("string") for k in key), value.cast("string")), 256)


def targets(df: DataFrame, by: list[str], item: str, methods: dict[str, list[Column]], budget: int) -> DataFrame:
    """(by, method, item, position): the first `budget` of each context by each method's order; ties end in the item.

    All methods share one shuffle by context.
    """
    at = df.withColumns({f"_{m}": F.row_number().over(Window.partitionBy(*by).orderBy(*order, F.col(item))) for m, order in methods.items()})
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"_{m}").alias("position")) for m in methods))).alias("x")
    return at.select(*by, item, each).select(*by, "x.method", item, "x.position").where(F.col("position") <= budget)


def prior_history(df: DataFrame, by: list[str], item: str, at: str, score: str, value: str) -> DataFrame:
    """Adds what was known of each item strictly before `at`: stable, raw, last and observations.

    Unknown items have a score of 0.5 and the group's mean value before; nothing before is 0.5 and 0.
    """
    own = Window.partitionBy(*by, item).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, at).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    past = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, at, F.try_divide(F.sum("_s").over(past), F.sum("_n").over(past)).alias("_mean"))
    x = df.withColumns({
        "stable": F.coalesce(F.avg(score).over(own), F.lit(0.5)), "_raw": F.avg(value).over(own),
        "last": F.coalesce(F.max(F.struct(at, score)).over(own)[score], F.lit(0.5)), "observations": F.count(F.lit(1)).over(own)})
    x = x.join(sums, [*by, at])
    return x.withColumn("raw", F.coalesce("_raw", "_mean", F.lit(0.0))).drop("_raw", "_mean")


def greedy_sets(weights: DataFrame, by: list[str], budget: int, seed: int) -> DataFrame:
    """(by, node, position): nodes that in turn add most to sum_v max_{s chosen} w(s, v), for all contexts at once.

    `weights` are (by, node, partner, w), both ways. A turn is one join and one arg-max by context over all contexts, and its
    tables are written; what a chosen node holds is no gain any more. Ties go by a hash of the node.
    """
    turns = Turns(weights.sparkSession)
    left = turns.kept(weights.select(*by, "node", "partner", "w"), "left")
    covered = turns.kept(left.select(*by, F.col("partner").alias("v")).distinct().withColumn("c", F.lit(0.0)), "covered")
    chosen = None
    for turn in range(1, budget + 1):
        gain = left.join(covered.withColumnRenamed("v", "partner"), [*by, "partner"], "left").groupBy(*by, "node").agg(F.sum(F.greatest(F.lit(0.0), F.col("w") - F.coalesce("c", F.col("w")))).alias("gain"))
        key = F.struct(-F.round("gain", 6), hash_order(F.col("node"), seed, "history_coverage_ties"), "node")
        best = gain.groupBy(*by).agg(F.min_by("node", key).alias("node")).withColumn("position", F.lit(turn))
        best = turns.kept(best, f"best{turn}")
        chosen = best if chosen is None else chosen.union(best)
        if turn == budget:
            break
        held = left.join(best.drop("position"), [*by, "node"], "left_semi").select(*by, F.col("partner").alias("v"), F.col("w").alias("x"))
        now = covered.join(held, [*by, "v"], "left").select(*by, "v", F.greatest("c", F.coalesce("x", F.lit(0.0))).alias("c"))
        now = now.join(best.select(*by, F.col("node").alias("v")), [*by, "v"], "left_anti")  # a chosen node needs no cover: null is no gain
        covered = turns.kept(now, "covered")
        left = turns.kept(left.join(best.drop("position"), [*by, "node"], "left_anti"), "left")
    turns.drop("left", "covered")
    return chosen.select(*by, "node", "position")


def greedy_coverage(weights: DataFrame, budget: int, seed: int) -> DataFrame:
    """(node, position) of `greedy_sets` in a single context."""
    return greedy_sets(weights.withColumn("_all", F.lit(1)), ["_all"], budget, seed).drop("_all")


def group_coverage(memberships: DataFrame, seconds: float, budget: int, seed: int) -> DataFrame:
    """`greedy_coverage` of the pairs of groups (group_id, node_id), by `seconds` shared among the others of a group.

    Where there are fewer copies of memberships than pairs, gains are added up in tiles of nodes, so that no pair is
    written or shuffled. Before anything is chosen a node's gain is the time of its groups.
    """
    spark = memberships.sparkSession
    turns = Turns(spark)
    some = turns.kept(memberships.select("group_id", "node_id"), "memberships")
    size = turns.kept(tiles.sizes(some), "sizes")
    if not tiles.pays(size, some.select("node_id")):
        return greedy_coverage(exposure.both_ways(exposure.joined_pairs(some, seconds), "contact_seconds").toDF("node", "partner", "w"), budget, seed)
    held = tiles.blocks(turns, some, size)
    others = held.flat.groupBy("g").agg((F.count("*") - 1).alias("others"))
    gain = held.flat.join(others, "g").groupBy("i").agg(F.sum(F.lit(seconds) / (F.col("n") - 1) * F.col("others")).alias("gain"))
    cover = held.who.select("i", F.lit(0.0).alias("c"))
    chosen = []
    for turn in range(1, budget + 1):
        left = gain.join(held.who, "i").where(~F.col("i").isin([i for i, _ in chosen]))
        best = left.select("i", "node_id", F.struct(-F.round("gain", 6), hash_order(F.col("node_id"), seed, "history_coverage_ties"), "node_id").alias("key")).agg(F.min_by(F.struct("i", "node_id"), "key").alias("b")).first()["b"]
        if best is None:
            break
        chosen.append((best["i"], best["node_id"]))
        if turn < budget:
            groups = held.flat.where(F.col("i") == best["i"]).select("g")
            met = held.flat.join(groups, "g", "left_semi").groupBy("i").agg(F.sum(F.lit(seconds) / (F.col("n") - 1)).alias("x"))
            now = F.when(F.col("i") == best["i"], F.lit(float("inf"))).otherwise(F.greatest("c", F.coalesce("x", F.lit(0.0))))  # a chosen node needs no cover
            cover = turns.kept(cover.join(met, "i", "left").select("i", now.alias("c")), "cover")
            gain = turns.kept(tiles.gains(held, cover, seconds), "gain")
    turns.drop("memberships", "sizes", "numbers", "groups", "flat", "packed", "cover", "gain")
    kind = dict(memberships.dtypes)["node_id"]
    return spark.createDataFrame([(node, k) for k, (_, node) in enumerate(chosen, 1)], f"node {kind}, position int")


def chronological_test(df: DataFrame, by: list[str], at: str, fraction: float, train: int = 2) -> DataFrame:
    """(by, at, test): the last ceil(fraction * n) moments are for tests, where `train` or more are left."""
    moments = df.select(*by, at).distinct()
    n = F.count("*").over(Window.partitionBy(*by))
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))
    held = F.ceil(n * fraction)
    return moments.withColumn("test", (back <= held) & (n - held >= train))


def calibrated_threshold(df: DataFrame, margin: str, gain: str, thresholds: list[float]) -> DataFrame:
    """(threshold, overrides, mean_gain): each threshold's overrides; the least whose mean gain isn't negative is `chosen`."""
    each = df.select(F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"), margin, gain)
    x = each.groupBy("threshold").agg(F.count_if(F.col(margin) >= F.col("threshold")).alias("overrides"), F.coalesce(F.avg(F.when(F.col(margin) >= F.col("threshold"), F.col(gain))), F.lit(0.0)).alias("mean_gain"))
    fit = x.where("mean_gain >= 0 and overrides > 0").agg(F.min("threshold").alias("least"))
    return x.crossJoin(F.broadcast(fit)).select("threshold", "overrides", "mean_gain", (F.col("threshold") == F.coalesce("least", F.lit(float("inf")))).alias("chosen"))  # one row
