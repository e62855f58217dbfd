"""Aggregate measures that give the same answer however the data is split.

Floating-point sums depend on the order rows are added, which depends on
partitioning, so a re-run on a different cluster could flip a rounded digit.
These helpers sum in integers (cents, or fixed-point units for coordinates)
and round with integer arithmetic, half-up, as the reference's SQL does:

* ``money_sum``: exact decimal sum, reported as double (the nearest one:
  beyond about $9e13 a double no longer tells cents apart).
* ``mean_half_up``: mean of a decimal / integer column rounded half-up to
  ``digits`` places from its exact decimal sum.
* ``coord_mean``: mean of a double coordinate from nano-unit fixed-point sums
  (decimal, so a hot group of 10^11 rows cannot overflow).

All are algebraic (sum and count), so Spark runs them as partial
aggregation before the shuffle: a key holding a third of all rows costs one
row per task in the exchange, never one task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 1e9


def money_sum(c: Column) -> Column:
    """Exact sum of a decimal column, as double."""
    return F.sum(c).cast("double")


def mean_half_up(c: Column, digits: int, scale_digits: int = 2) -> Column:
    """Mean rounded half-up to ``digits`` places; null for an empty group.

    ``scale_digits`` is the column's own scale (2 for money, 0 for ints). Sum,
    count and the doubled numerator stay DECIMAL(38), so no group that fits a
    table overflows.
    """
    exact = lambda x: x.cast("decimal(38,0)")
    s = exact(F.sum(c.cast(f"decimal(22,{scale_digits})")) * F.lit(10 ** scale_digits).cast("decimal(4,0)"))
    n = exact(F.count(c))
    up, down = 10 ** max(digits - scale_digits, 0), 10 ** max(scale_digits - digits, 0)
    num, den = exact(F.abs(s) * F.lit(2 * up).cast("decimal(6,0)")), exact(n * F.lit(down).cast("decimal(6,0)"))
    mag = F.call_function("div", exact(num + den), exact(den * F.lit(2).cast("decimal(1,0)")))
    q = F.when(s >= 0, mag).otherwise(-mag)
    return F.when(F.count(c) > 0, q / F.lit(float(10 ** digits)))


def mean_of_sums(total: Column, n: Column, digits: int) -> Column:
    """``total / n`` (a DECIMAL with 2 places, a count) rounded half-up to ``digits`` places; null if ``n`` is 0."""
    exact = lambda x: x.cast("decimal(38,0)")
    cents, count = exact(total * F.lit(100).cast("decimal(3,0)")), exact(n)
    twice = exact(F.abs(cents) * F.lit(2 * 10 ** (digits - 2)).cast("decimal(6,0)"))
    size = F.call_function("div", exact(twice + count), exact(count * F.lit(2).cast("decimal(1,0)")))
    return F.when(n > 0, F.when(cents >= 0, size).otherwise(-size) / F.lit(float(10 ** digits)))


def coord_mean(c: Column) -> Column:
    """Mean of a double from an exact fixed-point (1e-9) sum; null if empty."""
    units = F.floor(c * F.lit(NANO) + F.lit(0.5)).cast("decimal(20,0)")
    n = F.count(c)
    return F.when(n > 0, F.sum(units).cast("double") / n / F.lit(NANO))


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding of a double as ``floor(x·10^d + 0.5)/10^d``."""
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
