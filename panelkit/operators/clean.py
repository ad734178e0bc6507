"""Column selection by name, renaming, recoding."""

from collections.abc import Sequence
import re

from pyspark.sql import DataFrame, functions as F


def cols_like(df: DataFrame, prefix: str | None = None, suffix: str | None = None,
              contains: str | None = None) -> list[str]:
    """Column names that fit every given part."""
    return [c for c in df.columns
            if (prefix is None or c.startswith(prefix))
            and (suffix is None or c.endswith(suffix))
            and (contains is None or contains in c)]


def rename_like(df: DataFrame, pattern: str, repl: str) -> DataFrame:
    """Rename all columns by a regular expression in one projection."""
    return df.toDF(*[re.sub(pattern, repl, c) for c in df.columns])


def latest_column(df: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
    """The ids and the last column of a wide table, which holds its newest date."""
    return df.select(*ids, F.col(f"`{df.columns[-1]}`").alias(name))


def recode(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Replace codes by descriptions from ``mapping(code, description)``; unknown codes stay."""
    m = mapping.select(F.col(mapping.columns[0]).alias("_code"), F.col(mapping.columns[1]).alias("_text"))
    return (df.join(m, F.col(col) == F.col("_code"), "left")
              .withColumn(col, F.coalesce("_text", col))
              .drop("_code", "_text"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without a single value; one counting pass over the data."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if filled[i] == 0])
