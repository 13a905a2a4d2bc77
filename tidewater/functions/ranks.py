"""Ranks with ties: by counts of values, so that no context has to be sorted row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(df: DataFrame, value: str, by: list[str], name: str, share: bool = False) -> DataFrame:
    """Adds `name`: the mean position of equal values in their group, or its share of the group; null for null.

    Rows are counted by value first; only distinct values are ordered, and their places join back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    place = F.coalesce(F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("_c") + 1) / 2.0
    place = place / F.sum("_c").over(group) if share else place
    ranks = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(value).alias("_value"), place.alias(name))
    same = [df[c].eqNullSafe(ranks[f"_{c}"]) for c in by]
    return df.join(ranks, [*same, df[value] == ranks["_value"]], "left").select(*df.columns, name)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, spearman): null where a side is constant or has fewer than two values."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_rank(average_rank(kept, x, by, "rank_x"), y, by, "rank_y")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("rank_x", "rank_y").alias("spearman"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Rows that one task puts in order.
BUCKET = 100_000


def _placed(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds places from 1 in the order of buckets, and of `order` inside of them."""
    at = df.withColumn("_b", bucket)
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # one row a bucket
    heads = at.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(before, F.lit(0)).alias("_h"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return at.withColumn("_r", inside).join(heads, "_b").withColumn(name, (F.col("_h") + F.col("_r")).cast("long")).drop("_b", "_r", "_h")


def hash_position(df: DataFrame, u: str, tie: str, name: str = "position") -> DataFrame:
    """Adds each row's place in the order of a keyed number `u` in (0, 1): counts of buckets, and places inside them.

    There is a bucket for each BUCKET rows, so that none grows with the data.
    """
    many = df.agg(F.ceil(F.count("*") / BUCKET)).first()[0] or 1
    return _placed(df, F.floor(F.col(u) * many), [F.col(u), F.col(tie)], name)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): a number from 1 on for each key that isn't null, without gaps, the same for the same keys."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    many = keys.agg(F.ceil(F.count("*") / BUCKET)).first()[0] or 1
    return _placed(keys, F.pmod(F.xxhash64(key), F.lit(many)), [F.col(key)], name).select(key, name)


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their position; the order must end in an id."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= k)
