"""Fits from grouped sums: ridge without a family, and bootstraps over families."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import keyed


def ridge_without_each(df: DataFrame, family: str, y: str, xs: list[str], alpha: float, weight: str | None = None) -> DataFrame:
    """(family, coefficients): weighted ridge on all other families; the first coefficient is the intercept, without penalty.

    Rows with a null are left out. The sums of products are taken once a family and subtracted from their total;
    what is solved in Python is one small system a family, null where it is singular.
    """
    some = df.dropna(subset=[family, y, *xs]).select(F.col(family).alias("g"), F.lit(1.0).alias("x0"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs, 1)),
                                                     F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    size = len(xs) + 1
    names = [f"x{i}" for i in range(size)]
    products = {f"{a}_{b}": F.sum(F.col("w") * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in [*names[i:], "y"]}
    each = some.groupBy("g").agg(*(p.alias(n) for n, p in products.items()))
    total = F.broadcast(each.agg(*(F.sum(n).alias(f"all_{n}") for n in products)))  # one row
    rest = each.crossJoin(total).select("g", F.array(*(F.col(f"all_{n}") - F.col(n) for n in products)).alias("sums"))
    order = {n: i for i, n in enumerate(products)}

    def solve(frames):
        for f in frames:
            out = []
            for s in f["sums"]:
                a = np.array([[s[order[f"x{min(i, j)}_x{max(i, j)}"]] for j in range(size)] for i in range(size)])
                b = np.array([s[order[f"x{i}_y"]] for i in range(size)])
                penalty = np.diag([0.0] + [alpha] * (size - 1))
                try:
                    out.append(np.linalg.solve(a + penalty, b).tolist())
                except np.linalg.LinAlgError:
                    out.append(None)
            f = f[["g"]].copy()
            f["coefficients"] = out
            yield f

    kind = dict(rest.dtypes)["g"]
    return rest.mapInPandas(solve, f"g {kind}, coefficients array<double>").withColumnRenamed("g", family)


def bootstrap(df: DataFrame, by: list[str], unit: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """(by, units, mean, low, high, status): the mean over units and its percentile interval from keyed draws of units.

    A unit is one row of its mean value; `status` is "positive" or "negative" where the interval leaves 0 out, else "open".
    Draw d of replicate r depends on (seed, r, d) alone, and not on the partitioning.
    """
    means = df.groupBy(*by, unit).agg(F.avg(value).alias("v")).where("v is not null")
    among = Window.partitionBy(*by)
    held = means.select(*by, "v", (F.row_number().over(among.orderBy(unit)) - 1).cast("long").alias("i"), F.count("*").over(among).alias("units"))
    groups = held.groupBy(*by).agg(F.max("units").alias("units"))
    draws = groups.select(*by, "units", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("d"))
    drawn = draws.select(*by, "r", F.floor(keyed.uniform(seed, F.col("r"), F.col("d")) * F.col("units")).alias("i"))
    each = drawn.join(held.drop("units"), [*by, "i"]).groupBy(*by, "r").agg(F.avg("v").alias("m"))
    tail = (1 - level) / 2
    ends = each.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    out = held.groupBy(*by).agg(F.max("units").alias("units"), F.avg("v").alias("mean")).join(ends, by)
    return out.withColumn("status", F.when(F.col("low") > 0, "positive").when(F.col("high") < 0, "negative").otherwise("open"))
