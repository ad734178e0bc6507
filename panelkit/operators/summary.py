"""Distribution summaries and text collected in order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelkit.operators.selection import order_statistics


def _both_sides(places: Sequence[Column]) -> list[Column]:
    return [f(p) for p in places for f in (F.floor, F.ceil)]


def _type_7(total: Column, p: float) -> Column:
    return F.lit(1.0) + (total - 1) * F.lit(float(p))


def _between(i: int, place: Column) -> Column:
    """Linear interpolation between the ``i``-th pair of order statistics."""
    a, b = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
    return a + (place - F.floor(place)) * (b - a)


def quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between order statistics (type 7)."""
    found = order_statistics(df, col, lambda n: _both_sides([_type_7(n, p) for p in probs]))
    return list(found.select(*[_between(i, _type_7(F.col("total"), p)).alias(f"q{i}") for i, p in enumerate(probs)]).first())


def hinges(df: DataFrame, col: str) -> list[float | None]:
    """Minimum, lower hinge, median, upper hinge, maximum, as a box plot draws them."""
    def places(n: Column) -> list[Column]:
        depth = F.floor((n + 3) / 2) / 2
        return [F.lit(1), depth, (n + 1) / 2, n + 1 - depth, n]

    found = order_statistics(df, col, lambda n: _both_sides(places(n)))
    return list(found.select(*[((F.col(f"v{2 * i}") + F.col(f"v{2 * i + 1}")) / 2).alias(f"h{i}") for i in range(5)]).first())


def five_number(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one a group: min, q1, median, mean, q3, max, and the number of missing values.

    All of it comes from the same scans, two as a rule, without a sort.
    """
    probs = [0.25, 0.5, 0.75]
    extra = [F.col("_x"), F.when(F.col("_x").isNull(), 1).otherwise(0)]
    found = order_statistics(df, col, lambda n: [*_both_sides([_type_7(n, p) for p in probs]), F.lit(1), n], by, extra)
    q1, median, q3 = (_between(i, _type_7(F.col("total"), p)) for i, p in enumerate(probs))
    mean = F.when(F.col("total") > 0, F.col("e0") / F.col("total"))
    return found.select(*by, F.col("v6").alias("min"), q1.alias("q1"), median.alias("median"), mean.alias("mean"), q3.alias("q3"),
                        F.col("v7").alias("max"), F.coalesce("e1", F.lit(0)).cast("long").alias("missing"))


def box_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Rows outside the whiskers of a box plot: more than ``k`` hinge spreads beyond a hinge."""
    _, low, _, high, _ = hinges(df, col)
    if low is None:
        return df.where(F.lit(False))
    reach = k * (high - low)
    return df.where((F.col(col) < low - reach) | (F.col(col) > high + reach))


def date_span(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def join_lines(df: DataFrame, keys: Sequence[str], col: Column | str, order: str, name: str = "text") -> DataFrame:
    """Lines of each group joined by newlines in order; NULL if one line is missing.

    For report lines, one per state: the caller's lines per group are few.
    """
    line = F.col(col) if isinstance(col, str) else col
    lines = df.withColumn("_line", line)
    text = F.when(F.count("_line") == F.count(F.lit(1)), F.expr(f"listagg(_line, '\\n') WITHIN GROUP (ORDER BY `{order}`)"))
    return lines.groupBy(*keys).agg(text.alias(name))
