"""Solar Hijri calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.config import CalendarRange

#: Remainders by 33 of leap years (arithmetic rule): fixed values.
LEAP_REMAINDERS = (1, 5, 9, 13, 17, 22, 26, 30)


def is_leap_year(year: Column) -> Column:
    return (year % 33).isin(*LEAP_REMAINDERS)


def days_in_month(year: Column, month: Column) -> Column:
    return F.when(month <= 6, 31).when(month <= 11, 30).when(is_leap_year(year), 30).otherwise(29)


def is_valid_date(year: Column, month: Column, day: Column, years: CalendarRange = CalendarRange()) -> Column:
    """False, never null, for anything that isn't a date in range."""
    ok = year.between(years.min_year, years.max_year) & month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, month))
    return F.coalesce(ok, F.lit(False))
