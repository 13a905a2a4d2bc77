"""Ridge fits from sums of grouped products: over all earlier anchors, or over all other families."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expanding_ridge(df: DataFrame, series: list[str], at: str, context: list[str], targets: list[str], sets: dict[str, list[str]], alpha: float, least: int) -> DataFrame:
    """(series, at, prior_times, and target_set for each target and feature set): coefficients at each anchor time.

    A fit at time t uses the rows of its series with strictly smaller times; every context counts alike, whatever the
    number of its rows. Times with fewer than `least` earlier ones have no row. The first coefficient is the intercept,
    without penalty. Products are averaged once a context, added up once a time, and then run over the times; what is
    solved in Python is one small system a time and set, null where it is singular. Rows with a null are left out.
    """
    if least < 1:
        raise ValueError("at least one earlier time is needed")
    some, value, pairs = _products(df, [*series, at], targets, sets)
    each = some.groupBy(*series, at, *context).agg(*(F.avg(value[a] * value[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    every = [f"p{k}" for k in range(len(pairs))]
    by_time = each.groupBy(*series, at).agg(F.count("*").alias("contexts"), *(F.sum(p).alias(p) for p in every))
    past = Window.partitionBy(*series).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    run = by_time.select(*series, at, F.count("*").over(past).cast("int").alias("prior_times"), *((F.sum(p).over(past) / F.sum("contexts").over(past)).alias(p) for p in every))
    run = run.where(F.col("prior_times") >= least).select(*series, at, "prior_times", F.array(*every).alias("sums"))
    return _solved(run, [*series, at, "prior_times"], pairs, {f"{t}_{n}": (t, ["1", *c]) for t in targets for n, c in sets.items()}, alpha, False)


def _products(df: DataFrame, keys: list[str], targets: list[str], sets: dict[str, list[str]]) -> tuple[DataFrame, dict, list[tuple[str, str]]]:
    """The rows without a null, their values as doubles by name, and the pairs of names whose products a fit needs."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    value = {"1": F.lit(1.0), **{c: F.col(c).cast("double") for c in [*columns, *targets]}}
    names = ["1", *columns]
    return df.dropna(subset=[*keys, *columns, *targets]), value, [(a, b) for i, a in enumerate(names) for b in [*names[i:], *targets]]


def _solved(sums: DataFrame, kept: list[str], pairs: list[tuple[str, str]], made: dict[str, tuple[str, list[str]]], alpha: float, standardised: bool) -> DataFrame:
    """(kept, and coefficients for each name of `made`) of rows with an array `sums` in the order of the pairs."""
    place = {p: k for k, p in enumerate(pairs)}
    place |= {(b, a): k for (a, b), k in place.items()}

    def solve(frames):
        for f in frames:
            out = f[kept].copy()
            sums = np.stack(f["sums"].to_numpy()) if len(f) else np.zeros((0, len(pairs)))
            for name, (target, use) in made.items():
                a, b = sums[:, [[place[i, j] for j in use] for i in use]], sums[:, [place[i, target] for i in use]]
                found = []
                for m, y in zip(a, b, strict=True):
                    try:
                        found.append((_scaled if standardised else _plain)(m, y, alpha).tolist())
                    except np.linalg.LinAlgError:
                        found.append(None)
                out[name] = found
            yield out

    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{n}` array<double>" for n in made)])
    return sums.mapInPandas(solve, schema)


def _plain(m: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(m + np.diag([0.0] + [alpha] * (len(y) - 1)), y)


def _scaled(m: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """A fit on columns of mean 0 and deviation 1, in coefficients of the columns as they are; constant ones are only centred."""
    n = m[0, 0]
    if not n > 0:
        raise np.linalg.LinAlgError
    mean = m[0, 1:] / n
    inner = m[1:, 1:] / n - np.outer(mean, mean)
    size = np.sqrt(np.where(np.diag(inner) > 1e-12, np.diag(inner), 1.0))
    c = np.linalg.solve(n * inner / np.outer(size, size) + alpha * np.eye(len(mean)), (y[1:] - mean * y[0]) / size) / size
    return np.concatenate([[y[0] / n - c @ mean], c])


def family_ridge(df: DataFrame, family: str, context: list[str], targets: list[str], sets: dict[str, list[str]], alpha: float, standardised: bool = False) -> DataFrame:
    """(family, training_families, and target_set for each target and feature set): fits on all other families.

    Families count alike, and so do the contexts of one, whatever the number of their rows: products are averaged by context
    and by family, and a family's own are taken off the sum of all. A single family has no row. With `standardised`, the
    penalty is on columns that the training rows put to a mean of 0 and a deviation of 1. Rows with a null are left out.
    """
    some, value, pairs = _products(df, [family, *context], targets, sets)
    every = [f"p{k}" for k in range(len(pairs))]
    each = some.groupBy(family, *context).agg(*(F.avg(value[a] * value[b]).alias(p) for p, (a, b) in zip(every, pairs, strict=True)))
    own = each.groupBy(family).agg(*(F.avg(p).alias(p) for p in every))
    total = F.broadcast(own.agg(F.count("*").alias("n"), *(F.sum(p).alias(f"all_{p}") for p in every)))  # one row
    rest = own.crossJoin(total).where("n > 1").select(family, (F.col("n") - 1).cast("int").alias("training_families"), F.array(*(F.col(f"all_{p}") - F.col(p) for p in every)).alias("sums"))
    return _solved(rest, [family, "training_families"], pairs, {f"{t}_{n}": (t, ["1", *c]) for t in targets for n, c in sets.items()}, alpha, standardised)


def predictions(df: DataFrame, fits: DataFrame, keys: list[str], targets: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """The rows of `df` whose keys have a fit, with what else the fits tell and a prediction target_set for each."""
    x = df.join(fits.withColumnsRenamed({f"{t}_{s}": f"_{t}_{s}" for t in targets for s in sets}), keys)
    got = {}
    for t in targets:
        for s, columns in sets.items():
            of = F.col(f"_{t}_{s}")
            got[f"{t}_{s}"] = F.get(of, F.lit(0)) + sum((F.get(of, F.lit(k)) * F.col(c).cast("double") for k, c in enumerate(columns, 1)), F.lit(0.0))
    return x.withColumns(got).drop(*(f"_{n}" for n in got))
