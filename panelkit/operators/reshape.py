"""Wide to long and back."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelkit.functions.text import LEVEL


def _dates(names: Sequence[str], date_fmt: str) -> Column:
    """Column names as one constant array of dates; a name that is no date gives NULL."""
    return F.array(*[F.try_to_timestamp(F.lit(n), F.lit(date_fmt)).cast("date") for n in names])


def pack_dates(df: DataFrame, ids: Sequence[str], value: str, dates: Sequence[str] | None = None) -> DataFrame:
    """The date columns of a wide table as one array column, in the order of ``dates``.

    Without ``dates`` all columns but the ids are taken. A date the table lacks is NULL in the array.
    """
    dates = [c for c in df.columns if c not in ids] if dates is None else dates
    have = set(df.columns)
    cells = [F.col(f"`{c}`") if c in have else F.lit(None) for c in dates]
    return df.select(*ids, F.array(*cells).alias(value))


def unpack_dates(df: DataFrame, values: Sequence[str], dates: Sequence[str], date_fmt: str = "yyyy-MM-dd") -> DataFrame:
    """One row per date from array columns that run along ``dates``; a missing array counts as all NULL.

    Exploding keeps the partitioning of ``df``: rows shuffled before, while they are few, stay together.
    """
    blank = F.array_repeat(F.lit(None), len(dates))
    arrays = [F.coalesce(F.col(v), blank).alias(v) for v in values]
    keep = [c for c in df.columns if c not in values]
    long = df.select(*keep, F.explode(F.arrays_zip(_dates(dates, date_fmt).alias("date"), *arrays)).alias("_c"))
    return long.select(*keep, *[F.col(f"_c.`{n}`").alias(n) for n in ("date", *values)])


def melt_panel(df: DataFrame, ids: Sequence[str], value: str, date_fmt: str = "yyyy-MM-dd") -> DataFrame:
    """One row per id and date column; column names become dates.

    The whole row turns into one array that is exploded, so thousands of date columns cost one pass
    over the row and one generator, not one projection per column.
    """
    dates = [c for c in df.columns if c not in ids]
    return unpack_dates(pack_dates(df, ids, value, dates), [value], dates, date_fmt)


def spread(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str | Sequence[str],
           names: Sequence) -> DataFrame:
    """Long to wide, one row per key, first non-null value per cell.

    The list of names is given, so no pass over the data is needed to find it. With several value
    columns the new names read ``<value>_<name>``.
    """
    values = [values_from] if isinstance(values_from, str) else list(values_from)
    aggs = [F.first(v, ignorenulls=True).alias(v) for v in values]
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(*aggs)
    if len(values) == 1:
        return wide
    back: Mapping[str, str] = {f"{n}_{v}": f"{v}_{n}" for n in names for v in values}
    return wide.select(*keys, *[F.col(f"`{a}`").alias(b) for a, b in back.items()])


def split_label(df: DataFrame, col: str, into: Sequence[str], sep: str = LEVEL) -> DataFrame:
    """Split a label into columns. Missing parts on the right are NULL, surplus parts are dropped."""
    parts = F.split(F.col(col), sep)
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(into)])


def upper_triangle(matrix: DataFrame) -> DataFrame:
    """The part of a long matrix on and above the diagonal, without empty cells."""
    return matrix.where((F.col("row") <= F.col("col")) & F.col("r").isNotNull())


def menu(df: DataFrame, col: str) -> DataFrame:
    """Sorted list of the values of one column."""
    return df.select(col).distinct().orderBy(col)
