"""Digit and date-text expressions; each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.config import CalendarRange
from daftar.functions.calendar import is_valid_date
from daftar.functions.let import let

LATIN = "0123456789"
PERSIAN = "".join(chr(0x06F0 + i) for i in range(10))
ARABIC = "".join(chr(0x0660 + i) for i in range(10))
#: Signs that recognisers put for a slash: \ | - . : and four foreign ones.
SEPARATORS = r"[\\|\-.:،٫٬⁄／]"


def to_latin_digits(text: Column) -> Column:
    """Persian and Arabic-Indic digits as 0-9; null as the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), PERSIAN + ARABIC, LATIN + LATIN)


def to_persian_digits(text: Column) -> Column:
    return F.translate(text, LATIN, PERSIAN)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def repair_structure(text: Column) -> Column:
    """Put date text into year/month/day order and slashes; digits are never changed."""
    s = F.regexp_replace(to_latin_digits(text), SEPARATORS, "/")
    s = F.regexp_replace(F.regexp_replace(s, "[^0-9/]", ""), "/+", "/")
    s = F.regexp_replace(s, "^/|/$", "")
    s = F.regexp_replace(s, "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1/$2/$3")
    return F.regexp_replace(s, "^([0-9]{0,2})/([0-9]*)/([0-9]{4})$", "$3/$2/$1")


def format_date(year: Column, month: Column, day: Column) -> Column:
    """Zero-padded year/month/day; null if a part is null, as the empty string."""
    made = F.concat(year.cast("string"), F.lit("/"), F.lpad(month.cast("string"), 2, "0"), F.lit("/"), F.lpad(day.cast("string"), 2, "0"))
    return F.coalesce(made, F.lit(""))


DATE = "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$"


def date_parts(repaired: Column) -> Column:
    """``struct<year,month,day>`` of repaired date text; parts are null where it has another form."""
    part = lambda i, name: F.regexp_extract(repaired, DATE, i).try_cast("int").alias(name)
    return F.struct(part(1, "year"), part(2, "month"), part(3, "day"))


def with_dates(rows: DataFrame, text: Column, years: CalendarRange = CalendarRange()) -> DataFrame:
    """The rows whose text is a valid date, with year, month, day and formatted.

    The parts are generated, one row each, so that the test of the date can't be pushed below them and
    the text is repaired once.
    """
    repaired = rows.withColumn("repaired", repair_structure(text))
    parts = repaired.select("*", F.inline(F.array(date_parts(F.col("repaired"))))).drop("repaired")
    y, m, d = F.col("year"), F.col("month"), F.col("day")
    return parts.where(is_valid_date(y, m, d, years)).withColumn("formatted", format_date(y, m, d))


def parse_date(text: Column, years: CalendarRange = CalendarRange()) -> Column:
    """``struct<year,month,day,formatted>`` of valid date text, else null; for whole tables see ``with_dates``."""

    def made(p: Column) -> Column:
        date = F.struct(*(p[k].alias(k) for k in ("year", "month", "day")), format_date(p["year"], p["month"], p["day"]).alias("formatted"))
        return F.when(is_valid_date(p["year"], p["month"], p["day"], years), date)

    return let(repair_structure(text), lambda s: let(date_parts(s), made))
