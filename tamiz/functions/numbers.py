"""Numeric expressions whose rounding, null and zero rules matter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_double(c: Column) -> Column:
    """Number or null, never an error."""
    return c.try_cast("double")


def to_int(c: Column) -> Column:
    """Whole number or null; fractions are rounded, halves away from zero."""
    return F.round(c.try_cast("double"), 0).try_cast("int")


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient, null for a zero or missing divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rate_per(cases: Column, population: Column, per: float = 100000.0) -> Column:
    """Rate per ``per`` inhabitants; null without a positive population."""
    return F.when(population > 0, cases * F.lit(per) / population)


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    share = safe_ratio(part * F.lit(100.0), whole)
    return share if digits is None else F.round(share, digits)


def half_even(c: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(c, digits)


def null_to_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def finite_log(c: Column) -> Column:
    """Natural log; null where it is not finite."""
    return F.when(c > 0, F.ln(c))


def distinct_periods(period: Column) -> Column:
    """Aggregate: number of distinct periods, the missing one counting once."""
    return F.count_distinct(period) + F.max(F.when(period.isNull(), 1).otherwise(0))


def fixed_point(c: Column, scale: int) -> Column:
    """Amount as a whole number of its last decimal place: exact, order-free sums."""
    return F.round(c * F.lit(float(10**scale)), 0).cast("bigint")


def exact_sum(c: Column, scale: int | None) -> Column:
    """Aggregate sum; with ``scale`` it is exact for values of that many decimals."""
    if scale is None:
        return F.sum(c)
    return F.sum(fixed_point(c, scale)) / F.lit(float(10**scale))
