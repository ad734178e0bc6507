"""Number repair, rounding and null-strict sums."""

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c: Column | str) -> Column:
    """Text count to double: all Unicode punctuation goes (commas, but also ``-`` and ``.``).

    Meant for whole, non-negative counts only. Text that is still no number becomes NULL.
    """
    return F.regexp_replace(F.trim(F.regexp_replace(_col(c), r"\p{P}", "")), r"^\s+|\s+$", "").try_cast("double")


def decensor(c: Column | str, token: str, value: float) -> Column:
    """A censored token such as ``<=5`` stands for ``value``; everything else is read as a number."""
    c = _col(c)
    return F.when(F.trim(c) == token, F.lit(float(value))).otherwise(F.trim(c).try_cast("double"))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that gives NULL for a zero or missing divisor."""
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def per_capita(count: Column | str, population: Column | str, per: float = 100000) -> Column:
    return ratio(count, population) * F.lit(float(per))


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(_col(c), digits)


def signif(c: Column | str, n: int) -> Column:
    """Keep ``n`` significant digits; zero stays zero."""
    c = _col(c).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.bround(c * scale) / scale)


def sum_strict(c: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def range_midpoint(c: Column | str) -> Column:
    """Midpoint of a published range such as ``3,000 - 3,999``."""
    text = F.regexp_replace(_col(c), ",", "")
    part = r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$"
    low = F.regexp_extract(text, part, 1).try_cast("double")
    high = F.regexp_extract(text, part, 2).try_cast("double")
    return (low + high) / 2


def number_text(c: Column | str, digits: int = 2) -> Column:
    """Rounded number as shown to readers: no trailing zeros, no exponent."""
    shown = F.bround(_col(c).cast("double"), digits).cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(shown, r"\.?0+$", "") if digits else shown
