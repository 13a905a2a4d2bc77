"""Contrasts of arms on one key: pivots by conditional aggregation, never self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(df: DataFrame, keys: list[str], arm: str, value: str, arms: list[str]) -> DataFrame:
    """(keys, a column for each arm): the arm's mean value, null where it is absent."""
    return df.where(F.col(arm).isin(*arms)).groupBy(*keys).agg(*(F.avg(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms))


def contrasts(df: DataFrame, keys: list[str], arm: str, value: str, named: dict[str, tuple[str, str]], per: str | None = None) -> DataFrame:
    """(keys, contrast, difference): reference less challenger of each named pair, over the column `per` if given."""
    arms = sorted({a for pair in named.values() for a in pair})
    w = wide(df, keys, arm, value, arms)
    over = F.col(per) if per else F.lit(1.0)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("contrast"), ((F.col(a) - F.col(b)) / over).alias("difference")) for n, (a, b) in named.items()))).alias("x")
    return w.select(*keys, each).select(*keys, "x.contrast", "x.difference").where("difference is not null")


def path(df: DataFrame, keys: list[str], arm: str, value: str, steps: list[str]) -> DataFrame:
    """(keys, a part for each step, total, interaction): parts along a path of arms add up to the total.

    `interaction` is the second difference of the first, second, third and fourth arm.
    """
    w = wide(df, keys, arm, value, steps)
    parts = [(F.col(a) - F.col(b)).alias(f"{a}_to_{b}") for a, b in zip(steps, steps[1:], strict=False)]
    second = (F.col(steps[0]) - F.col(steps[1])) - (F.col(steps[2]) - F.col(steps[3])) if len(steps) > 3 else F.lit(None).cast("double")
    return w.select(*keys, *parts, (F.col(steps[0]) - F.col(steps[-1])).alias("total"), second.alias("interaction"))


def members(column: Column) -> Column:
    """The set of a list written with bars; empty for null and for the empty string."""
    return F.array_distinct(F.array_remove(F.split(F.coalesce(column, F.lit("")), r"\|"), ""))


def set_geometry(left: Column, right: Column, without: Column | None = None) -> tuple[Column, Column]:
    """(equal, Jaccard similarity) of two sets written with bars, with one member left out; two empty ones are alike."""
    a, b = members(left), members(right)
    if without is not None:
        a, b = F.array_remove(a, without), F.array_remove(b, without)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (both == either), F.when(either == 0, 1.0).otherwise(both / either)


def reconstruction(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """(matched, left_only, right_only, repeated, largest, agree): a full outer join of two tables that should hold the same values.

    Null keys meet each other. `repeated` counts keys that one of the tables has more than once, each taken once with its
    least value; `agree` says that nothing is missing, repeated or null on one side only, and no value differs by more than `tolerance`.
    """
    one = lambda df, v, n: df.groupBy(*(F.col(k).alias(f"{v}{i}") for i, k in enumerate(keys))).agg(F.min(value).alias(v), F.count("*").alias(n))
    a, b = one(left, "_a", "_l"), one(right, "_b", "_r")
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & a[f"_a{i}"].eqNullSafe(b[f"_b{i}"])
    x = a.join(b, same, "full_outer")
    count = F.count_if
    x = x.agg(
        count(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), count(F.col("_r").isNull()).alias("left_only"), count(F.col("_l").isNull()).alias("right_only"),
        count((F.coalesce("_l", F.lit(1)) > 1) | (F.coalesce("_r", F.lit(1)) > 1)).alias("repeated"), F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("largest"),
        count(F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_a").isNull() != F.col("_b").isNull())).alias("_odd"))
    return x.select("matched", "left_only", "right_only", "repeated", "largest", ((F.col("left_only") + F.col("right_only") + F.col("repeated") + F.col("_odd") == 0) & (F.col("largest") <= tolerance)).alias("agree"))


def effect_status(mean: Column, low: Column, high: Column) -> Column:
    """The sign of an effect by its interval."""
    return (F.when(low > 0, "supported_positive").when(high < 0, "supported_negative").when(mean > 0, "uncertain_positive").when(mean < 0, "uncertain_negative").otherwise("zero"))


def leave_one_out_choice(cells: DataFrame, by: list[str], family: str, policy: str, loss: str, cost: str, reference: str, selector: str) -> DataFrame:
    """(by, held_out, policy, mean_improvement, least_improvement, most_regret): the policy chosen on all other families.

    Selectors: "mean", "maximin" (the best least improvement on the reference), "regret" (the least
    greatest regret); ties by mean improvement, cost and name. Families and policies are few.
    """
    best = cells.groupBy(*by, family).agg(F.min(loss).alias("_best"), F.max(F.when(F.col(policy) == reference, F.col(loss))).alias("_ref"))
    x = cells.join(best, [*by, family]).select(*by, family, policy, cost, (F.col("_ref") - F.col(loss)).alias("gain"), (F.col(loss) - F.col("_best")).alias("regret"))
    held = cells.select(*by, F.col(family).alias("held_out")).distinct()
    x = x.join(held, by).where(F.col(family) != F.col("held_out"))
    x = x.groupBy(*by, "held_out", policy, cost).agg(F.avg("gain").alias("mean_improvement"), F.min("gain").alias("least_improvement"), F.max("regret").alias("most_regret"))
    first = {"mean": ["-mean_improvement", "-least_improvement"], "maximin": ["-least_improvement", "-mean_improvement"], "regret": ["most_regret", "-mean_improvement"]}[selector]
    key = F.struct(*(F.round(F.expr(e), 12).alias(f"k{i}") for i, e in enumerate(first)), F.col(cost).alias("k2"), F.col(policy).alias("k3"))
    return x.groupBy(*by, "held_out").agg(F.min_by(F.struct(policy, "mean_improvement", "least_improvement", "most_regret"), key).alias("c")).select(*by, "held_out", "c.*")
