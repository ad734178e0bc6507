"""Joins beyond the native ones."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on every column name the two sides share."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the two sides share no column")
    return a.join(b, shared, "inner")


def group_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on grouping keys as a grouping sees them: a missing key matches a missing key."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return a.join(other, same, how).drop(*[f"_{k}" for k in keys])


def full_join_all(dfs: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Chain of full outer joins on one key.

    A column that an earlier side already holds is dropped from the later one, so no suffixes appear.
    """
    keys = [on] if isinstance(on, str) else list(on)

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        seen = [c for c in right.columns if c in left.columns and c not in keys]
        return left.join(right.drop(*seen), keys, "full")

    return reduce(add, dfs)
