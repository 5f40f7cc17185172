"""Null-safe scalar expressions. NULL is the only missing value: ratios that can't be formed are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.params import EPSILON


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """x within [lo, hi]; NULL stays NULL (greatest and least alone would skip it)."""
    out = x
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    if lo is not None:
        out = F.greatest(F.lit(float(lo)), out)
    return F.when(x.isNotNull(), out)


def bounded(x: Column, lo: float, hi: float) -> Column:
    """``clip`` of a value that is never NULL; x is written, and so evaluated, once."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def zero_if_odd(x: Column) -> Column:
    """NULL, NaN and infinities as 0. (NaN is not below infinity here, and a comparison with NULL is not true.)"""
    return F.coalesce(F.when(F.abs(x) < F.lit(float("inf")), x), F.lit(0.0))


def or_else(x: Column, other) -> Column:
    return F.coalesce(x, other if isinstance(other, Column) else F.lit(float(other)))


def floor_eps(x: Column, zero_as: float = EPSILON) -> Column:
    """A divisor: 0 replaced, then at least epsilon; NULL stays NULL."""
    return clip(x if zero_as == EPSILON else F.when(x == 0, F.lit(float(zero_as))).otherwise(x), lo=EPSILON)


def missing_as_null(x: Column) -> Column:
    """NaN as NULL, for use at a scan."""
    return F.when(~F.isnan(x), x)


def true(c: Column) -> Column:
    """A mask: NULL is false."""
    return F.coalesce(c, F.lit(False))


def printed(x: Column, decimals: int, sign: str = "") -> Column:
    """x as text with a number of decimals, rounded half away from zero.

    Values a rounding error below a tie count as the tie, and those below 1e-9 as 0, so that no rounding error shows.
    """
    ten = 10.0**decimals
    size = F.floor(F.abs(x) * ten + 0.500001).cast("double") / ten
    return F.format_string(f"{sign}%.{decimals}f", F.when(F.abs(x) < 1e-9, 0.0).when(x < 0, -size).otherwise(size))
