"""Grouping values into bands and code lists."""

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from panelkit.functions.numbers import _col


def band(c: Column | str, limits: Sequence[tuple[float, str]], top: str) -> Column:
    """Numeric bands: the first ``(limit, name)`` with value < limit, else ``top``. NULL stays NULL."""
    c = _col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(c < limit, F.lit(name))
    return out.otherwise(F.lit(top))


def group_of(c: Column | str, groups: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """Name of the group that lists the value, else ``default``."""
    c = _col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, members in groups.items():
        out = out.when(c.isin(list(members)), F.lit(name))
    return out.otherwise(F.lit(default))


def flag(c: Column | str, value: str, then: str = "No", otherwise: str = "Yes") -> Column:
    """Two-way recode on equality; NULL stays NULL."""
    c = _col(c)
    return F.when(c == value, F.lit(then)).when(c.isNotNull(), F.lit(otherwise))


def code_list(table: str, *numbers: int | Iterable[int]) -> list[str]:
    """``code_list("C24060", range(2, 7))`` gives ``C24060_002`` to ``C24060_006``."""
    flat: list[int] = []
    for n in numbers:
        flat.extend([n] if isinstance(n, int) else n)
    return [f"{table}_{n:03d}" for n in flat]
