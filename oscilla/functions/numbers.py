"""Numbers for reports: rates, rounding, intervals. All stay null where a denominator is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def ratio(n: Column, d: Column) -> Column:
    """n / d in doubles, null for d = 0 (ANSI mode would raise)."""
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def percentage(n: Column, total: Column) -> Column:
    """100 n / total at 6 places, half to even; null for total 0, and for a share that is not zero but rounds to it."""
    made = F.bround(100 * ratio(n, total), 6)
    return F.when((n != 0) & (made == 0), None).otherwise(made)


def rate(n: Column, d: Column) -> Column:
    """n / d at 12 places."""
    return F.round(ratio(n, d), 12)


def public_number(x: Column) -> Column:
    """Half-even at 6 places; null for NaN, infinities and values that vanish; never minus zero."""
    made = F.bround(x, 6)
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite & ~((x != 0) & (made == 0)), made + F.lit(0.0))


def wilson(n: Column, d: Column) -> Column:
    """struct(low, high): the Wilson interval at 95 %, null for d = 0."""
    p, z2 = ratio(n, d), Z95 * Z95
    scale = 1 + z2 / F.nullif(d.cast("double"), F.lit(0.0))
    centre = (p + z2 / (2 * F.nullif(d.cast("double"), F.lit(0.0)))) / scale
    half = Z95 * F.sqrt(p * (1 - p) / F.nullif(d.cast("double"), F.lit(0.0)) + z2 / (4 * F.nullif(d.cast("double") * d.cast("double"), F.lit(0.0)))) / scale
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def within_tolerance(observed: Column, expected: Column, absolute: float = 1e-6, relative: float = 1e-6) -> Column:
    """|o - e| <= max(absolute, relative * max(|o|, |e|)), both ends included."""
    return F.abs(observed - expected) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(observed), F.abs(expected)))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
