"""A value computed once and used many times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
