"""Addressable randomness: numbers that depend on a key alone, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(*parts: Column | str | int) -> Column:
    cols = [F.lit(str(p)) if isinstance(p, int) else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, 16), 16, 10)


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from the first 64 bits of a hash of the parts."""
    return (_word(*parts).cast("double") + 0.5) / 2.0**64


def exponential(*parts: Column | str | int) -> Column:
    """A standard exponential variate."""
    return -F.log(uniform(*parts))


def erlang(stages: int, rate: float, *parts: Column | str | int) -> Column:
    """Mean of `stages` exponential stages, divided by the rate; null where the rate isn't positive."""
    if rate <= 0:
        return F.lit(None).cast("double")
    total = F.lit(0.0)
    for s in range(stages):
        total = total + exponential(*parts, s)
    return total / (stages * rate)


def seed(*parts: Column | str | int) -> Column:
    """A seed below 2 ** 63 - 1."""
    return (_word(*parts).cast("decimal(20,0)") % F.lit(9223372036854775807).cast("decimal(20,0)")).cast("long")
