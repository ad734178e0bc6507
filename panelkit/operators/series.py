"""Differences and rolling means along the dates of one entity.

A panel holds one row per entity and date, so the rows of one window group are bounded by the number of
calendar days and not by the size of the raw data. Aggregate raw records to that grain first.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.functions import sum_strict, sunday_week


def rolling_mean_strict(col: Column | str, keys: Sequence[str], order: str, n: int) -> Column:
    """Mean over the last ``n`` rows, NULL until ``n`` values are there."""
    c = F.col(col) if isinstance(col, str) else col
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def _no_negative(c: Column) -> Column:
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def daily_new(df: DataFrame, keys: Sequence[str], order: str, cum: str, clamp: str = "after",
              n: int = 7) -> DataFrame:
    """Add ``new_cases`` and ``moving_7_day_avg`` from a cumulative count.

    ``clamp`` says when negative corrections become 0: ``after`` the mean was taken, ``before`` it, or
    ``none``. The first row is compared with 0; a NULL before it gives NULL.
    """
    if clamp not in ("after", "before", "none"):
        raise ValueError(f"unknown clamp: {clamp}")
    w = Window.partitionBy(*keys).orderBy(order)
    previous = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.lag(cum).over(w))
    out = df.withColumn("new_cases", F.col(cum).cast("double") - previous)
    if clamp == "before":
        out = out.withColumn("new_cases", _no_negative(F.col("new_cases")))
    out = out.withColumn("moving_7_day_avg", rolling_mean_strict("new_cases", keys, order, n))
    if clamp == "after":
        out = out.withColumn("new_cases", _no_negative(F.col("new_cases")))
    return out


def weekly_totals(panel: DataFrame, key: str = "state", date: str = "date", value: str = "new_cases",
                  n: int = 3) -> DataFrame:
    """Sums per Sunday week and key, with the mean of the last ``n`` weeks."""
    weeks = (panel.groupBy(key, sunday_week(date).alias("week"))
                  .agg(sum_strict(value).alias("state_new_cases")))
    return weeks.withColumn("moving_3wk_avg", rolling_mean_strict("state_new_cases", [key], "week", n))
