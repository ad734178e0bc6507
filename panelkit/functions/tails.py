"""Tail areas of the t and F distributions, for the few rows of a test result."""

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Workers need not have this package on their path: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


STEPS = 5_000_000


def _stirling(z: float) -> float:
    """What the logarithm of the gamma function has beyond Stirling's leading terms, for z >= 10."""
    w = 1 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z


def _front(x: float, y: float, a: float, b: float) -> float:
    """x^a y^b / B(a, b) without differences of large numbers; y = 1 - x."""
    if min(a, b) >= 10:
        gap = x * b - y * a
        return math.sqrt(a * b / (2 * math.pi * (a + b))) * math.exp(
            a * math.log1p(gap / a) + b * math.log1p(-gap / b) + _stirling(a + b) - _stirling(a) - _stirling(b))
    if max(a, b) >= 10:
        if a < b:
            x, y, a, b = y, x, b, a
        log_x = math.log1p(-y) if y < 0.5 else math.log(x)
        grown = (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + _stirling(a + b) - _stirling(a)
        return math.exp(a * log_x + b * math.log(y) + grown - math.lgamma(b))
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(y))


def beta_area(x: float, a: float, b: float, y: float | None = None) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction.

    ``y`` is 1 - x, given by callers that know it better than the difference. A fraction that does not settle raises.
    """
    y = 1 - x if y is None else y
    if math.isnan(x) or x <= 0:
        return 0.0 if x <= 0 else math.nan
    if y <= 0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_area(y, b, a, x)
    front = _front(x, y, a, b)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, STEPS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * total / a
    raise ArithmeticError(f"no tail area for x={x}, a={a}, b={b} within {STEPS} steps")


def t_tail(t: float, df: float) -> float:
    """Two-sided p value of a t statistic."""
    if df is None or t is None or df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    square = t * t
    return beta_area(df / (df + square), df / 2, 0.5, square / (df + square))


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of an F statistic."""
    if f is None or df1 is None or df2 is None or df1 <= 0 or df2 <= 0 or math.isnan(f):
        return math.nan
    if math.isinf(f):
        return 0.0
    return beta_area(df2 / (df2 + df1 * f), df2 / 2, df1 / 2, df1 * f / (df2 + df1 * f))


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(a, b, c) for a, b, c in zip(f, df1, df2)], dtype="float64")


def t_two_sided(t: Column, df: Column) -> Column:
    p = _t_two_sided(t.cast("double"), df.cast("double"))
    return F.when(F.isnan(p), None).otherwise(p)


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    p = _f_upper(f.cast("double"), df1.cast("double"), df2.cast("double"))
    return F.when(F.isnan(p), None).otherwise(p)
