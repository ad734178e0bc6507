"""Calendar helpers."""

from pyspark.sql import Column, functions as F

from panelkit.functions.numbers import _col


def sunday_week(c: Column | str) -> Column:
    """The Sunday that starts the week of a date."""
    day = _col(c).cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1)


def long_date(c: Column | str) -> Column:
    """``January 22, 2020``."""
    return F.date_format(_col(c), "MMMM dd, yyyy")


def short_date(c: Column | str) -> Column:
    """``01/22/2020``."""
    return F.date_format(_col(c), "MM/dd/yyyy")


def parse_us_date(c: Column | str, pattern: str = "MMMM d, yyyy") -> Column:
    """A month-day-year date in words or digits; text that is no date becomes NULL.

    Two-digit years from 69 on belong to the last century.
    """
    day = F.try_to_timestamp(_col(c), F.lit(pattern)).cast("date")
    if "yy" in pattern and "yyyy" not in pattern:
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return day
