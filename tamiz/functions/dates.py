"""Date parsing and period buckets."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DateType, StructType


def parse_day_month_year(c: Column) -> Column:
    """``d/M/yyyy`` text (one or two digits) as a date, null when impossible."""
    return F.try_to_timestamp(F.trim(c), F.lit("d/M/yyyy")).cast("date")


def parse_dotted(c: Column) -> Column:
    """``d.M.yyyy`` text as a date, null when impossible."""
    return F.try_to_timestamp(F.trim(c), F.lit("d.M.yyyy")).cast("date")


def as_date(schema: StructType, name: str) -> Column:
    """The column itself when it is a date, else a cast that turns failures into null."""
    if isinstance(schema[name].dataType, DateType):
        return F.col(name)
    return F.col(name).try_cast("date")


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def year_bucket(c: Column, first: int = 2022, last: int = 2024) -> Column:
    """Year as text inside ``first..last``, else null."""
    year = F.year(c)
    return F.when(year.between(first, last), year.cast("string"))


def semester_bucket(c: Column, first: int = 2023, last: int = 2024) -> Column:
    """``YYYY-I`` or ``YYYY-II`` inside ``first..last``, else null."""
    half = F.when(F.month(c) <= 6, F.lit("I")).otherwise(F.lit("II"))
    return F.when(F.year(c).between(first, last), F.concat_ws("-", F.year(c).cast("string"), half))


def in_period(c: Column, start: str, end: str) -> Column:
    """Both ends included."""
    return c.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def years_between(c: Column, reference: date) -> Column:
    """Whole 365-day years up to ``reference``, rounded down also before birth."""
    days = F.datediff(F.lit(reference), c)
    return F.floor(days / F.lit(365)).cast("int")


def in_years(c: Column, years: Iterable[int]) -> Column:
    return F.year(c).isin(list(years))
