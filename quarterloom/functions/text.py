"""Labels and numbers for reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_label(year: Column, quarter: Column) -> Column:
    return F.format_string("%d Q%d", year.cast("int"), quarter.cast("int"))


def grouped(c: Column, digits: int = 0) -> Column:
    """A number with thousands separators."""
    return F.format_number(c, digits)


def percent(c: Column, digits: int = 2) -> Column:
    """A share as a percentage."""
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def duration(seconds: Column) -> Column:
    """Seconds below a minute with one digit, minutes and seconds below an hour, else hours and minutes."""
    whole = lambda c: F.floor(c).cast("int")
    minutes = F.format_string("%dm %ss", whole(seconds / 60), F.format_number(F.pmod(seconds, F.lit(60.0)), 0))
    hours = F.format_string("%dh %dm", whole(seconds / 3600), whole(F.pmod(seconds, F.lit(3600.0)) / 60))
    return F.when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit("s"))).when(seconds < 3600, minutes).otherwise(hours)
