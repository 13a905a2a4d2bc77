"""Saturation curves 1 - exp(-rate * dose), fitted on a fixed grid of rates.

Losses of all rates come from one pass over the rows, as sums by group; fits that leave a family out, or that use
earlier times only, add and subtract those sums. The grid is a parameter of some tens of rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def curve(dose: Column, rate: Column | float) -> Column:
    """The share that a dose reaches."""
    return 1 - F.exp(-(rate if isinstance(rate, Column) else F.lit(float(rate))) * dose)


def loss_of(kind: str, predicted: Column, outcome: Column) -> Column:
    """The loss of a prediction: "log_loss" or "absolute_error"."""
    if kind == "absolute_error":
        return F.abs(predicted - outcome)
    if kind != "log_loss":
        raise ValueError(f"no loss {kind!r}")
    p = F.least(F.greatest(predicted, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(outcome * F.log(p) + (1 - outcome) * F.log(1 - p))


def group_losses(df: DataFrame, by: list[str], dose: str, outcome: str, rates: list[float], kind: str, weight: str | None = None) -> DataFrame:
    """(by, rows, rate_index, loss): each group's weighted mean loss at each rate.

    Where the weights of a group add up to nothing, its rows count alike. Rows with a null dose or outcome are left out.
    """
    some = df.where(F.col(dose).isNotNull() & F.col(outcome).isNotNull())
    losses = [loss_of(kind, curve(F.col(dose), r), F.col(outcome).cast("double")) for r in rates]
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    x = some.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(w).alias("_w"), F.array(*(F.sum(w * v) for v in losses)).alias("_a"), F.array(*(F.avg(v) for v in losses)).alias("_b"))
    of = F.when(F.col("_w") > 0, F.transform("_a", lambda v: v / F.col("_w"))).otherwise(F.col("_b"))
    return x.select(*by, "rows", F.posexplode(of).alias("rate_index", "loss"))


def _least(losses: DataFrame, by: list[str], rates: list[float]) -> DataFrame:
    """(by, rate): the first of the rates with the least loss."""
    grid = F.array(*(F.lit(float(r)) for r in rates))
    best = losses.groupBy(*by).agg(F.min(F.struct(F.round("loss", 12).alias("loss"), "rate_index")).alias("b"))
    return best.select(*by, F.get(grid, F.col("b.rate_index")).alias("rate"))


def fit_without_each(df: DataFrame, by: list[str], family: str, dose: str, outcome: str, rates: list[float], kind: str, weight: str | None = None) -> DataFrame:
    """(by, family, rate, training_families, training_rows): the fit on all other families of the group, which count alike.

    A group of a single family has no row.
    """
    each = group_losses(df, [*by, family], dose, outcome, rates, kind, weight)
    whole = each.groupBy(*by, "rate_index").agg(F.sum("loss").alias("_l"), F.count("*").alias("_f"), F.sum("rows").alias("_n"))
    rest = each.join(whole, [*by, "rate_index"]).where("_f > 1").select(*by, family, "rate_index", ((F.col("_l") - F.col("loss")) / (F.col("_f") - 1)).alias("loss"), (F.col("_f") - 1).alias("training_families"), (F.col("_n") - F.col("rows")).alias("training_rows"))
    return _least(rest, [*by, family, "training_families", "training_rows"], rates)


def fit_before_each(df: DataFrame, by: list[str], at: str, dose: str, outcome: str, rates: list[float], kind: str, least: int, weight: str | None = None) -> DataFrame:
    """(by, at, rate, prior_times, training_rows, latest): the fit on all strictly earlier times of the group, which count alike.

    Times with fewer than `least` earlier ones have no row.
    """
    each = group_losses(df, [*by, at], dose, outcome, rates, kind, weight)
    past = Window.partitionBy(*by, "rate_index").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    run = each.select(*by, at, "rate_index", F.avg("loss").over(past).alias("loss"), F.count("*").over(past).alias("prior_times"), F.sum("rows").over(past).alias("training_rows"), F.max(at).over(past).alias("latest"))
    return _least(run.where(F.col("prior_times") >= least), [*by, at, "prior_times", "training_rows", "latest"], rates)
