"""Labels and names."""

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from panelkit.functions.numbers import _col

LEVEL = "!!"


def label_depth(c: Column | str) -> Column:
    """How many level marks a hierarchical label holds."""
    return F.regexp_count(_col(c), F.lit(LEVEL))


def last_part(c: Column | str) -> Column:
    """The deepest level of a hierarchical label."""
    return F.element_at(F.split(_col(c), LEVEL), -1)


def title_name(c: Column | str) -> Column:
    """``new_cases`` to ``New Cases``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def extract_or_null(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The matched group, NULL without a match."""
    c = _col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def canonical(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace literal spellings by the agreed ones."""
    c = _col(c)
    for old, new in mapping.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
