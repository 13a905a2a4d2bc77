"""Grouped statistics: hierarchical means, leave-one-out, sign tests, variance shares, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import ranks


def hierarchical_mean(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Means of means: over the last level first, then over each above; one row a first level."""
    out = df.groupBy(*levels).agg(F.avg(value).alias("mean"))
    for k in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:k]).agg(F.avg("mean").alias("mean"))
    return out


def leave_one_out(df: DataFrame, value: str) -> DataFrame:
    """Each row with the mean of all others; meant for one row a family."""
    total = df.agg(F.sum(value).alias("all_sum"), F.count(value).alias("all_n"))
    return df.crossJoin(F.broadcast(total)).withColumn("others", (F.col("all_sum") - F.col(value)) / (F.col("all_n") - 1)).drop("all_sum", "all_n")


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) of n fair coins: terms by their logarithms, each from the one before, for any n."""
    k, n = k.cast("int"), n.cast("int")
    first = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, j: a + F.when(j > 0, F.log((n - k + j) / j)).otherwise(0.0))
    zero = F.struct(F.lit(0.0).alias("p"), (first - n * F.log(F.lit(2.0))).alias("t"))
    step = lambda a, i: F.struct((a["p"] + F.exp(a["t"])).alias("p"), (a["t"] + F.when(i < n, F.log((n - i) / (i + 1))).otherwise(0.0)).alias("t"))
    return F.when(k <= n, F.aggregate(F.sequence(k, n), zero, step, lambda a: a["p"])).otherwise(0.0)


def two_way(df: DataFrame, rows: str, cols: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Sums of squares of a two-way layout without repeats, and their shares, by unit: rows present in every column only.

    Row and column means are grouped sums that join back; status tells units without two rows and two columns.
    """
    by = by or []
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, rows, cols).agg(F.avg(value).alias("_v"))
    per_row = cells.groupBy(*by, rows).agg(F.count("*").alias("_c"))
    size = cells.groupBy(*by).agg(F.countDistinct(cols).alias("n_cols"), F.countDistinct(rows).alias("n_seen"))
    on = lambda a, b, cs: a.join(b, cs) if cs else a.crossJoin(F.broadcast(b))
    full = on(cells.join(on(per_row, size, by).where("_c = n_cols").select(*by, rows), [*by, rows]), size, by)
    r = full.groupBy(*by, rows).agg(F.avg("_v").alias("_rm"))
    c = full.groupBy(*by, cols).agg(F.avg("_v").alias("_cm"))
    m = full.groupBy(*by).agg(F.avg("_v").alias("_m"))
    x = on(full.join(r, [*by, rows]).join(c, [*by, cols]), m, by)
    square = lambda e: F.coalesce(F.sum(F.pow(e, F.lit(2.0))), F.lit(0.0))
    x = x.groupBy(*by).agg(
        F.count("_v").alias("n_cells"), F.countDistinct(rows).alias("n_rows"), square(F.col("_v") - F.col("_m")).alias("ss_total"), square(F.col("_rm") - F.col("_m")).alias("ss_rows"),
        square(F.col("_cm") - F.col("_m")).alias("ss_cols"), square(F.col("_v") - F.col("_rm") - F.col("_cm") + F.col("_m")).alias("ss_residual"))
    x = size.join(x, by, "left") if by else size.crossJoin(x)
    enough = (F.coalesce("n_rows", F.lit(0)) >= 2) & (F.col("n_cols") >= 2)
    status = F.when(~enough, "not_estimable").when(F.col("ss_total") > 0, "estimated").otherwise("constant_target")
    share = lambda ss: F.when(enough, F.coalesce(F.try_divide(F.col(ss), F.col("ss_total")), F.lit(0.0)))
    return x.select(
        *by, F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "ss_total", "ss_rows", "ss_cols", "ss_residual", "n_seen", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_cols",
        status.alias("status"), share("ss_rows").alias("row_fraction"), share("ss_cols").alias("col_fraction"), share("ss_residual").alias("residual_fraction"))


def spearman_brown(r: Column, repeats: Column | int) -> Column:
    """Reliability of the mean of repeats from that of one: 0 where r isn't positive, null where it isn't a number."""
    k = F.lit(repeats) if isinstance(repeats, int) else repeats
    return F.when(r.isNull() | F.isnan(r), None).when(r <= 0, 0.0).otherwise(k * r / (1 + (k - 1) * r))


def block_reliability(df: DataFrame, by: list[str], item: str, block: str, value: str) -> DataFrame:
    """(by, items, blocks, ms_between, ms_within, icc_single, icc_mean) over items measured in every block."""
    cells = df.groupBy(*by, item, block).agg(F.avg(value).alias("v"))
    blocks = cells.groupBy(*by).agg(F.countDistinct(block).alias("blocks"))
    items = cells.groupBy(*by, item).agg(F.avg("v").alias("m"), F.var_samp("v").alias("w"), F.count("*").alias("c")).join(blocks, by).where("c = blocks and blocks > 1")
    x = items.groupBy(*by).agg(F.count("*").alias("items"), F.max("blocks").alias("blocks"), (F.max("blocks") * F.var_samp("m")).alias("ms_between"), F.avg("w").alias("ms_within"))
    b, w, k = F.col("ms_between"), F.col("ms_within"), F.col("blocks")
    return x.where("items > 1").select(*by, "items", "blocks", "ms_between", "ms_within", F.try_divide(b - w, b + (k - 1) * w).alias("icc_single"), F.try_divide(b - w, b).alias("icc_mean"))


def family_summary(df: DataFrame, family: str, value: str, by: list[str]) -> DataFrame:
    """(by, families, mean, median, low, high, positive, negative, least_without_one, most_without_one, p): one value a family."""
    f = df.groupBy(*by, family).agg(F.avg(value).alias("v"))
    total = f.groupBy(*by).agg(F.sum("v").alias("s"), F.count("*").alias("k"))
    without = F.try_divide(F.col("s") - F.col("v"), F.col("k") - 1)
    x = f.join(total, by).groupBy(*by).agg(
        F.count("*").alias("families"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") < 0).alias("negative"), F.min(without).alias("least_without_one"), F.max(without).alias("most_without_one"))
    return x.withColumn("p", binomial_tail(F.col("positive"), F.col("positive") + F.col("negative")))


def calibration(df: DataFrame, by: list[str], predicted: str, observed: str) -> DataFrame:
    """Errors and the regression of what was observed on what was predicted."""
    p, o = F.col(predicted), F.col(observed)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(p - o)).alias("mae"), F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"),
        F.regr_slope(o, p).alias("slope"), F.regr_intercept(o, p).alias("intercept"),
        (F.percentile(o, 0.9) - F.percentile(o, 0.1)).alias("spread"))


def prefix_means(df: DataFrame, by: list[str], item: str, block: str, value: str) -> DataFrame:
    """(by, item, level, m, final): each item's mean over the group's first `level` blocks, and over all of them.

    Levels are the blocks that the group has, in their order; an item has a row from the first of its blocks on. Sums run
    over the item's own blocks, and a level without one takes those before it.
    """
    blocks = df.select(*by, block).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(block)))
    held = df.where(F.col(value).isNotNull()).join(blocks, [*by, block])
    sums = held.groupBy(*by, item, "_i").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    own = Window.partitionBy(*by, item)
    run = own.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    last = blocks.groupBy(*by).agg(F.max("_i").alias("_last"))
    x = sums.join(last, by) if by else sums.crossJoin(F.broadcast(last))  # one row
    x = x.withColumns({"m": F.sum("_s").over(run) / F.sum("_n").over(run), "final": F.sum("_s").over(own) / F.sum("_n").over(own), "_next": F.lead("_i", 1).over(own.orderBy("_i"))})
    level = F.explode(F.sequence(F.col("_i"), F.coalesce(F.col("_next") - 1, F.col("_last")))).alias("level")
    return x.select(*by, item, level, "m", "final")


def precision_curve(df: DataFrame, by: list[str], item: str, block: str, value: str, top: int) -> DataFrame:
    """(by, level, items, reliability, spearman, top_overlap, zero_share): how item means settle as blocks are added.

    Levels are the group's first blocks, in their order. `reliability` is that of the mean over the level's blocks, null for one
    block; the others hold the level's means against those over all blocks, of the items seen so far: their rank
    correlation, the share of the final `top` items among the level's, and how many means are 0.
    """
    blocks = df.select(*by, block).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(block)))
    last = blocks.groupBy(*by).agg(F.max("_i").alias("_last"))
    nested = df.where(F.col(value).isNotNull()).join(blocks, [*by, block]).join(last, by).withColumn("level", F.explode(F.sequence("_i", "_last")))
    r = block_reliability(nested, [*by, "level"], item, block, value)
    r = r.select(*by, "level", spearman_brown(F.col("icc_single"), F.col("blocks")).alias("reliability"))
    p = prefix_means(df, by, item, block, value)
    rho = ranks.spearman(p, "m", "final", [*by, "level"]).select(*by, "level", "spearman")
    place = lambda v: F.row_number().over(Window.partitionBy(*by, "level").orderBy(F.desc(v), item)) <= top
    p = p.withColumns({"_m": place("m"), "_f": place("final")})
    x = p.groupBy(*by, "level").agg(
        F.count("*").alias("items"), F.try_divide(F.count_if(F.col("_m") & F.col("_f")), F.count_if("_f")).alias("top_overlap"), F.avg((F.col("m") == 0).cast("double")).alias("zero_share"))
    return x.join(rho, [*by, "level"], "left").join(r, [*by, "level"], "left").select(*by, "level", "items", "reliability", "spearman", "top_overlap", "zero_share")
