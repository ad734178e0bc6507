"""Correlation tests. Each needs one pass of mergeable aggregates over the data."""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelkit.functions import half_even, ratio, t_two_sided
from panelkit.operators.moments import pair_moments
from panelkit.operators.ordering import ranked_values
from panelkit.session import settle


def tested(test: DataFrame) -> DataFrame:
    """From r and n: degrees of freedom, t, p and the 95 % interval by Fisher's z.

    A perfect correlation has an infinite t, p = 0 and the interval [r, r]; with n < 3 there is no test, with n = 3 no
    interval.
    """
    df, r = F.col("n") - 2, F.col("r")
    perfect, inf = (F.abs(r) == 1) & (df > 0), F.lit(float("inf"))
    t = F.when(perfect, F.when(r > 0, inf).otherwise(-inf)).when(df > 0, r * F.sqrt(ratio(df, (1 - r) * (1 + r))))
    half = F.lit(1.959963984540054) / F.sqrt(F.when(F.col("n") > 3, F.col("n") - 3))
    z = F.atanh(F.when(F.abs(r) < 1, r))
    end = lambda sign: F.when(perfect & (F.col("n") > 3), r).otherwise(F.tanh(z + sign * half))
    return (test.withColumn("df", df).withColumn("t", t)
                .withColumn("p", t_two_sided(F.col("t"), F.col("df")))
                .withColumn("low", end(-1)).withColumn("high", end(1)))


def cor_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over the pairs where both are present: r, n, df, t, p, low, high."""
    return tested(df.agg(*correlation_of(x, y)))


def correlation_of(x: str, y: str) -> list[Column]:
    """Aggregates ``r`` and ``n``, the pairs where both are present."""
    return [_corr(x, y).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n")]


def _corr(x: str, y: str) -> Column:
    """Pearson's r over complete pairs, NULL if a side is constant. Rounding can leave a perfect correlation a few units
    short of one, or beyond it."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    size = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    r = ratio(F.covar_pop(x, y), size)
    return F.when(F.abs(r) >= 1 - 1e-14, F.signum(r)).otherwise(r)


def cor_with(df: DataFrame, target: str, min_abs: float = 0.7, cols: Sequence[str] | None = None,
             strict: bool = True) -> DataFrame:
    """Columns correlated with ``target`` by at least ``min_abs``, the strongest first.

    With ``strict`` a column that has a missing value, or whose target has, is left out; otherwise complete pairs count.
    """
    others = [c for c in (cols or df.columns) if c != target]
    whole = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.count(target) == F.count(F.lit(1)))
    row = df.agg(*[(F.when(whole(c), _corr(c, target)) if strict else _corr(c, target)).alias(c) for c in others])
    long = row.unpivot([], others, "variable", "r")
    return (long.where((F.abs("r") >= min_abs) & (F.col("r") != 1))
                .orderBy(F.abs("r").desc(), "variable"))


def cor_matrix(df: DataFrame, cols: Sequence[str], digits: int | None = 2, strict: bool = True) -> DataFrame:
    """Long correlation matrix ``(row, col, var1, var2, r, n)`` from one pass of matrix products.

    With ``strict`` a pair with any missing value gets NULL, otherwise the complete pairs count.
    """
    pairs = pair_moments(df, cols)
    r = pairs.correlation()
    cells = []
    for i, var1 in enumerate(cols):
        for j, var2 in enumerate(cols):
            value = None if np.isnan(r[i, j]) or strict and pairs.n[i, j] < pairs.rows else float(r[i, j])
            cells.append((i + 1, j + 1, var1, var2, value, int(pairs.n[i, j])))
    long = df.sparkSession.createDataFrame(cells, "row int, col int, var1 string, var2 string, r double, n long")
    return long if digits is None else long.withColumn("r", half_even("r", digits))


def cor_pvalues(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Matrix of correlation p values over complete pairs; the diagonal is 0."""
    long = cor_matrix(df, cols, digits=None, strict=False)
    test = tested(long).withColumn("p", F.when(F.col("row") == F.col("col"), F.lit(0.0)).otherwise(F.col("p")))
    return test.select("row", "col", "var1", "var2", "r", "n", "p")


def _mid_ranks(pairs: DataFrame, col: str, name: str) -> tuple[DataFrame, int]:
    """Mean position of every distinct value, and the number of rows."""
    ranks, total = ranked_values(pairs, col, F.col("times"))
    return ranks.select(F.col("value").alias(col), (F.col("upto") - (F.col("n") - 1) / 2).alias(name)), total


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mid-ranks for ties; p by the t approximation.

    Equal pairs are counted first, so frequent values shrink before anything is sorted or joined. Mid-ranks
    average (n + 1) / 2 exactly, which makes the sums centred from the start.
    """
    # read once: both rankings and the join use the counted pairs
    pairs = settle(df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna("any")
                   .groupBy("x", "y").agg(F.count(F.lit(1)).alias("times")))
    (ranks_x, total), (ranks_y, _) = _mid_ranks(pairs, "x", "rx"), _mid_ranks(pairs, "y", "ry")
    ranked = pairs.join(ranks_x, "x").join(ranks_y, "y")
    middle = F.lit((total + 1) / 2)
    centred = ranked.select("times", (F.col("rx") - middle).alias("a"), (F.col("ry") - middle).alias("b"))
    sums = centred.agg(F.sum("times").alias("n"), F.sum(F.expr("times * a * b")).alias("sab"),
                       F.sum(F.expr("times * a * a")).alias("saa"), F.sum(F.expr("times * b * b")).alias("sbb"))
    test = sums.select(ratio("sab", F.sqrt(F.col("saa") * F.col("sbb"))).alias("r"),
                       F.coalesce("n", F.lit(0)).alias("n"))
    return tested(test).drop("low", "high").withColumnRenamed("r", "rho")
