"""Decision gates over families of systems: levels of evidence, named decisions, and both with each family left out.

A gate asks of a contrast that the interval of its mean over families lies above a floor, and that enough families
agree. All groups, contrasts and left-out families are worked out together, as further keys of one bootstrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import resampling
from tidewater.operators.contrasts import effect_status

#: From the weakest on.
LEVELS = ("incomplete", "unsupported", "directional", "strong")


def gates(effects: DataFrame, by: list[str], contrast: str, family: str, unit: str, value: str, replicates: int, seed: int, share: float = 0.8, floor: float = 0.0) -> DataFrame:
    """(by, contrast, families, required, positive, mean, low, high, passes, level) of each contrast.

    A unit counts once, with the mean of its rows. `positive` families have a mean above 0, and `required` of them are
    ceil(share * families). A contrast passes, and is "strong", where the interval lies above `floor` and as many agree; it is
    "directional" where only its mean is above 0 and as many agree, else "unsupported".
    """
    x = resampling.multilevel_bootstrap(effects, [*by, contrast], [family, unit], value, replicates, seed)
    x = x.withColumns({"required": F.ceil(F.round(F.col("families") * share, 9)).cast("int"), "positive": F.round(F.col("positive_share") * F.col("families")).cast("int")})
    agree = F.col("positive") >= F.col("required")
    passes = (F.col("low") > floor) & agree
    level = F.when(passes, "strong").when((F.col("mean") > 0) & agree, "directional").otherwise("unsupported")
    return x.select(*by, contrast, "families", "required", "positive", "mean", "low", "high", passes.alias("passes"), level.alias("level"))


def decide(found: DataFrame, by: list[str], contrast: str, rules: list[tuple[str, list[str]]], otherwise: str) -> DataFrame:
    """(by, decision): the first rule whose contrasts all pass; one that isn't there doesn't."""
    passed = found.groupBy(*by).agg(F.collect_set(F.when(F.col("passes"), F.col(contrast))).alias("p"))  # at most the contrasts
    decision = F.lit(otherwise)
    for name, needed in reversed(rules):
        every = F.lit(True)
        for c in needed:
            every = every & F.array_contains("p", c)
        decision = F.when(every, name).otherwise(decision)
    return passed.select(*by, decision.alias("decision"))


def joint(found: DataFrame, by: list[str], across: str, contrast: str, required: list[str]) -> DataFrame:
    """(by, cells, level): the weakest level of the required contrasts in every `across` of a group; "incomplete" where one is missing."""
    rank = F.array_position(F.array(*(F.lit(v) for v in LEVELS)), F.col("level"))
    cells = found.groupBy(*by, across).agg(F.count_if(F.col(contrast).isin(required)).alias("n"), F.min(F.when(F.col(contrast).isin(required), rank)).alias("r"))
    weakest = F.when(F.min("n") < len(required), F.lit(1)).otherwise(F.min("r"))
    return cells.groupBy(*by).agg(F.sum("n").alias("cells"), weakest.alias("r")).select(*by, "cells", F.get(F.array(*(F.lit(v) for v in LEVELS)), (F.col("r") - 1).cast("int")).alias("level"))


def without_each(df: DataFrame, family: str, name: str = "held_out") -> DataFrame:
    """The rows of all other families for each family that is left out, and those of all (null); families are few.

    The result takes part in what follows as one more key, so that a gate with each family left out is one job.
    """
    held = df.select(F.col(family).alias(name)).distinct()
    pairs = df.select(family).distinct().join(held, F.col(family) != F.col(name)).groupBy(family).agg(F.collect_list(name).alias("_out"))  # of families
    kind = df.select(family).schema[0].dataType
    outs = F.concat(F.coalesce("_out", F.array().cast(f"array<{kind.simpleString()}>")), F.array(F.lit(None).cast(kind)))
    return df.join(pairs, family, "left").withColumn(name, F.explode(outs)).drop("_out")


def resilience(decisions: DataFrame, by: list[str], held_out: str) -> DataFrame:
    """(by, decision, folds, same, status): how many of the decisions with a family left out are that of all families.

    Status is "robust" where all are, "fragile" where fewer than half are, else "mixed".
    """
    whole = decisions.where(F.col(held_out).isNull()).select(*by, F.col("decision").alias("_d"))
    x = decisions.where(F.col(held_out).isNotNull()).join(whole, by).groupBy(*by).agg(F.first("_d").alias("decision"), F.count("*").alias("folds"), F.count_if(F.col("decision") == F.col("_d")).alias("same"))
    return x.withColumn("status", F.when(F.col("same") == F.col("folds"), "robust").when(F.col("same") * 2 < F.col("folds"), "fragile").otherwise("mixed"))


def frontier(ledger: DataFrame, estimand: str, dimensions: list[str], relative: str = "relative", absolute: str = "absolute") -> DataFrame:
    """One row for each setting that has both estimands: their means and statuses, and what may be decided.

    `ledger` holds mean, low and high of each setting; null dimensions meet each other, and a setting that an estimand has
    twice raises an error. Targeting is supported where both intervals lie above 0, additional targeting where the absolute one does.
    """
    def side(name, mark):
        some = ledger.where(F.col(estimand) == name).groupBy(*dimensions).agg(F.count("*").alias("c"), *(F.first(v).alias(v) for v in ("mean", "low", "high")))
        one = F.when(F.col("c") == 1, F.col("mean")).otherwise(F.raise_error(F.lit(f"a setting has several {name} rows")).cast("double"))
        return some.select(*(F.col(d).alias(f"{mark}{d}") for d in dimensions), one.alias(f"{mark}mean"), F.col("low").alias(f"{mark}low"), F.col("high").alias(f"{mark}high"))

    r, a = side(relative, "_r_"), side(absolute, "_a_")
    same = F.lit(True)
    for d in dimensions:
        same = same & F.col(f"_r_{d}").eqNullSafe(F.col(f"_a_{d}"))
    status = lambda m: effect_status(F.col(f"{m}mean"), F.col(f"{m}low"), F.col(f"{m}high"))
    decision = F.when((F.col("_a_low") > 0) & (F.col("_r_low") > 0), "direct_targeting_supported").when(F.col("_a_low") > 0, "additional_targeting_supported_policy_unresolved").otherwise("abstain_or_require_external_calibration")
    return r.join(a, same).select(
        *(F.col(f"_r_{d}").alias(d) for d in dimensions), F.col("_r_mean").alias("relative_mean"), F.col("_a_mean").alias("absolute_mean"), status("_r_").alias("relative_status"), status("_a_").alias("absolute_status"), decision.alias("decision"))


def evidence_classes(decisions: DataFrame, resilient: DataFrame, by: list[str], abstain: str, retain: str) -> DataFrame:
    """(by, decision, evidence): decisions joined to their resilience: "abstain", or robust or pooled support of either side."""
    x = decisions.select(*by, "decision").join(resilient.select(*by, "folds", "same"), by, "left")
    robust = F.col("same") == F.col("folds")
    evidence: Column = F.when(F.col("decision") == abstain, "abstain").when((F.col("decision") == retain) & robust, "robust_history").when(F.col("decision") == retain, "pooled_history_only").otherwise("pooled_override_only")
    return x.select(*by, "decision", evidence.alias("evidence"))
