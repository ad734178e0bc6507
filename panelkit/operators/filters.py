"""Row selection."""

from collections.abc import Sequence
import datetime as dt

from pyspark.sql import DataFrame, functions as F


def keep_in(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def drop_in(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def at_latest(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows at the newest date: a one-value subquery, no window and no join."""
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def at_date(df: DataFrame, date: str, d: dt.date | str) -> DataFrame:
    return df.where(F.col(date) == F.lit(d).cast("date"))


def split_unallocated(df: DataFrame, col: str = "county_name",
                      pattern: str = "Statewide Unallocated") -> tuple[DataFrame, DataFrame]:
    """The allocated rows and the rows no county could be given for."""
    hit = F.col(col).rlike(pattern)
    return df.where(~hit), df.where(hit)


def split_outliers(df: DataFrame, col: str, above: float | None = None,
                   ids: tuple[str, Sequence] | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with ``col`` below ``above`` and none of the named ids, and all the others.

    ``ids`` is ``(key column, values)`` or a frame whose columns are the key. A missing ``col`` does not pass the threshold;
    a missing key is none of the ids.
    """
    odd = F.lit(False) if above is None else ~F.coalesce(F.col(col) < above, F.lit(False))
    if isinstance(ids, DataFrame):
        mark = ids.distinct().withColumn("_named", F.lit(True))
        df = df.join(mark, ids.columns, "left")
        odd = odd | F.coalesce("_named", F.lit(False))
    elif ids is not None:
        odd = odd | F.coalesce(F.col(ids[0]).isin(list(ids[1])), F.lit(False))
    return df.where(~odd).drop("_named"), df.where(odd).drop("_named")


def without_outliers(df: DataFrame, col: str, above: float | None = None,
                     ids: tuple[str, Sequence] | DataFrame | None = None) -> DataFrame:
    """The first part of ``split_outliers``."""
    return split_outliers(df, col, above, ids)[0]
