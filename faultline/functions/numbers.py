"""Numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """Division that gives ``default`` (NULL if None) on a zero denominator, also in ANSI mode."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def clip_round(value: Column, low: Column, high: Column, digits: int = 4) -> Column:
    """Clip to [low, high], then round half-even."""
    return F.bround(F.least(F.greatest(value, low), high), digits)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based equal-width bin, last bin closed; a constant series falls into the middle bin."""
    pos = F.floor(F.try_divide((value - low) * bins, high - low)) + 1
    return F.when(high > low, F.least(F.greatest(pos, F.lit(1)), F.lit(bins))).otherwise(bins // 2 + 1).cast("int")


def min_max(value: Column, low: Column, high: Column, epsilon: float | None = None) -> Column:
    """Min-max scaling; a constant series gives 0, or value 0/epsilon when ``epsilon`` is set."""
    if epsilon is not None:
        return (value - low) / (high - low + F.lit(epsilon))
    return F.when(high > low, F.try_divide(value - low, high - low)).otherwise(F.lit(0.0))


def steady_avg(value: Column) -> Column:
    """Average that does not depend on the order in which rows meet, to the last digit as long as the sum stays below 2^33.

    Multiples of 2^-20 add up without rounding; what is left of each value is so small that the rounding of its sum does not show.
    """
    value = value.cast("double")
    usual = F.abs(value) < 2.0**32
    coarse = F.when(usual, F.rint(value * 2.0**20) / 2.0**20).otherwise(value)
    fine = F.when(usual, value - coarse).when(value.isNotNull(), F.lit(0.0))
    return ratio(F.sum(coarse) + F.sum(fine), F.count(value), None)
