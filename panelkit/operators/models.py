"""Analysis of variance, least squares, lasso and stepwise selection.

All linear models here depend on the data only through a triangular factor (least squares, stepwise selection) or
through counts, means and centred cross-products (lasso). Spark computes those once, as mergeable aggregates over the whole
table; what is solved afterwards is a matrix as wide as the number of predictors.
"""

from collections.abc import Mapping, Sequence
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelkit.functions import f_upper, ratio
from panelkit.functions.tails import t_tail
from panelkit.session import settle
from panelkit.operators.moments import Moments, fold_moments, triangle

INTERCEPT = "(Intercept)"
SWEEPS = 100_000


def anova(df: DataFrame, y: str, g: str) -> DataFrame:
    """One-way analysis of variance of ``y`` over the levels of ``g``: df, sums of squares, F and p."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(g).alias("level")).dropna("any")
    levels = rows.groupBy("level").agg(F.count("y").alias("n"), F.avg("y").alias("m"),
                                       (F.var_pop("y") * F.count("y")).alias("within"))
    levels = settle(levels)  # one read of the table; the two sums below are over its levels
    grand = levels.agg(ratio(F.sum(F.col("n") * F.col("m")), F.sum("n"))).scalar()
    parts = levels.select("n", "within", (F.col("n") * (F.col("m") - grand) * (F.col("m") - grand)).alias("between"))
    sums = parts.agg((F.count(F.lit(1)) - 1).alias("df_between"), (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
                     F.sum("between").alias("ss_between"), F.sum("within").alias("ss_within"))
    f = ratio(ratio("ss_between", "df_between"), ratio("ss_within", "df_within"))
    return sums.withColumn("f", f).withColumn("p", f_upper(F.col("f"), F.col("df_between"), F.col("df_within")))


def independent(r: np.ndarray, xs: Sequence[int], tolerance: float = 1e-7) -> list[int]:
    """Those of the columns ``xs`` of a triangular factor that are no combination of the ones before them and the constant (its
    column 0): the others are aliased.

    A column is aliased if less than ``tolerance`` of its length is left once the kept ones are projected out.
    """
    kept: list[int] = []
    basis = np.zeros((len(r), 0))
    for x in [0, *xs]:
        column = r[:, x]
        left = column - basis @ (basis.T @ column)
        left -= basis @ (basis.T @ left)  # twice, so that the rest is orthogonal to the last digit
        length = np.linalg.norm(left)
        if length > tolerance * np.linalg.norm(column):
            kept.append(x)
            basis = np.column_stack([basis, left / length])
    return kept[1:]


def _fit(r: np.ndarray, y: int, xs: Sequence[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (the constant first), the inverse triangle of their columns, and the residual sum of squares.

    Columns are scaled to length one first; the inverse is that of the columns as they are.
    """
    columns = r[:, [0, *xs, y]]
    scale = np.linalg.norm(columns[:, :-1], axis=0)
    small = np.linalg.qr(np.column_stack([columns[:, :-1] / scale, columns[:, -1]]), mode="r")
    k = len(scale)
    inverse = np.linalg.inv(small[:k, :k])
    rest = np.linalg.norm(small[k:, k])
    # what rounding leaves of a perfect fit is none
    rss = float(rest ** 2) if rest > 1e-14 * np.linalg.norm(columns[:, -1]) else 0.0
    return inverse @ small[:k, k] / scale, inverse / scale[:, None], rss


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares: one row per term with estimate, std_error, t, p, and the fit's r2, r2adj, n.

    A term that is constant or a combination of earlier ones is aliased: it is left out of the fit, its own numbers are
    NULL, and the degrees of freedom count the terms kept. r2 of a constant response is NULL.
    """
    k = len(xs) + 1
    n, r = triangle(df, [*xs, y])
    used = independent(r, range(1, k))
    slopes, inverse, rss = _fit(r, k, used)
    constant = not independent(r, [k], 1e-12)
    total = 0.0 if constant else _fit(r, k, [])[2]
    rss = 0.0 if constant else rss
    free = n - len(used) - 1
    sigma2 = rss / free if free > 0 else math.nan
    numbers = {x: (float(b), math.sqrt(sigma2 * float(v @ v))) for x, b, v in zip([0, *used], slopes, inverse)}
    r2 = float(1 - rss / total) if total > 0 else None
    r2adj = 1 - (1 - r2) * (n - 1) / free if r2 is not None and free > 0 else None
    known = lambda v: None if math.isnan(v) else v
    out = []
    for i, term in enumerate([INTERCEPT, *xs]):
        b, se = numbers.get(i, (math.nan, math.nan))
        t = b / se if se else math.copysign(math.inf, b) if b else math.nan
        out.append((i, term, known(b), known(se), known(t), known(t_tail(t, free)), r2, r2adj, n))
    return df.sparkSession.createDataFrame(
        out, "pos int, term string, estimate double, std_error double, t double, p double, "
             "r2 double, r2adj double, n long")


def _descend(corr: np.ndarray, target: np.ndarray, lam: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent for the lasso on standardised predictors, until no slope moves any more.

    Each sweep lowers a convex function, so it ends; a run of ``SWEEPS`` without an end raises instead of passing for one.
    """
    b = start.copy()
    for _ in range(SWEEPS):
        largest = 0.0
        for j in range(len(b)):
            if corr[j, j] == 0:
                continue
            rest = target[j] - corr[j] @ b + corr[j, j] * b[j]
            new = math.copysign(max(abs(rest) - lam, 0.0), rest) / corr[j, j]
            largest = max(largest, abs(new - b[j]))
            b[j] = new
        if largest < 1e-10 * max(1.0, float(np.abs(target).max())):
            return b
    raise ArithmeticError(f"the lasso did not settle in {SWEEPS} sweeps")


def lasso_path(m: Moments, lambdas: Sequence[float]) -> list[np.ndarray]:
    """Slopes in the units of the data for each penalty, the last column of ``m`` being the response.

    Minimises RSS / 2n + lambda * sum |slope * sd|, with the largest penalty first as a warm start.
    """
    k = len(m.mean) - 1
    sd = np.sqrt(np.diag(m.cross)[:k] / m.n)
    safe = np.where(sd == 0, 1.0, sd)
    corr = m.cross[:k, :k] / m.n / np.outer(safe, safe)
    target = m.cross[:k, k] / m.n / safe
    b, found = np.zeros(k), {}
    for lam in sorted(set(lambdas), reverse=True):
        b = _descend(corr, target, lam, b)
        found[lam] = b / safe
    return [found[lam] for lam in lambdas]


def default_lambdas(m: Moments, count: int = 100, ratio_to_max: float = 1e-4) -> list[float]:
    """From the smallest penalty that empties the model down, evenly on the log scale."""
    k = len(m.mean) - 1
    sd = np.sqrt(np.diag(m.cross)[:k] / m.n)
    top = float(np.max(np.abs(m.cross[:k, k] / m.n / np.where(sd == 0, 1.0, sd))))
    return [top * ratio_to_max ** (i / (count - 1)) for i in range(count)]


def lasso(df: DataFrame, y: str, xs: Sequence[str], lambdas: Sequence[float] | None = None, folds: int = 10,
          seed: int = 1, fold: str | None = None) -> DataFrame:
    """Lasso with the penalty chosen by cross-validation: one row per term, ``kept`` marks non-zero slopes.

    The table is read once, grouped by fold. Training sets are sums of fold moments, and the error on the held
    out fold is a quadratic form of its own moments, so the number of penalties and folds adds no pass. A row's fold is
    the whole number in the column ``fold``, or else follows from its values, so reruns agree.
    """
    k = len(xs)
    drawn = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c).cast("double") for c in [*xs, y]]), F.lit(folds))
    parts = fold_moments(df, [*xs, y], F.col(fold) if fold else drawn)
    if len(parts) < 2:
        raise ValueError("too few rows for cross-validation")
    whole = _sum(parts)
    grid = list(lambdas) if lambdas is not None else default_lambdas(whole)
    errors = np.zeros(len(grid))
    for i, held in enumerate(parts):
        train = _sum([p for j, p in enumerate(parts) if j != i])
        for g, slopes in enumerate(lasso_path(train, grid)):
            bias = held.mean[k] - train.mean[k] - slopes @ (held.mean[:k] - train.mean[:k])
            errors[g] += (held.cross[k, k] - 2 * slopes @ held.cross[:k, k]
                          + slopes @ held.cross[:k, :k] @ slopes + held.n * bias * bias)
    best = grid[int(np.argmin(errors))]
    slopes = lasso_path(whole, [best])[0]
    rows = [(0, INTERCEPT, float(whole.mean[k] - slopes @ whole.mean[:k]), True, float(best))]
    rows += [(i + 1, x, float(b), bool(b != 0), float(best)) for i, (x, b) in enumerate(zip(xs, slopes))]
    return df.sparkSession.createDataFrame(rows, "pos int, term string, estimate double, kept boolean, lambda double")


def _sum(parts: Sequence[Moments]) -> Moments:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def step_aic(df: DataFrame, y: str, xs: Sequence[str], direction: str = "both",
             start: Sequence[str] | None = None) -> DataFrame:
    """Stepwise selection by n ln(RSS / n) + 2 p: one row per step with the term added or dropped.

    ``forward`` and ``both`` begin with no predictor, ``backward`` with all, unless ``start`` says otherwise.
    ``terms`` holds the predictors after the step.
    """
    if direction not in ("forward", "backward", "both"):
        raise ValueError(f"unknown direction: {direction}")
    k = len(xs)
    n, r = triangle(df, [*xs, y])

    def aic(chosen: list[int]) -> float:
        """Aliased terms add nothing to the fit and count for nothing."""
        used = independent(r, [i + 1 for i in chosen])
        rss = _fit(r, k + 1, used)[2]
        return n * math.log(rss / n) + 2 * (len(used) + 1) if rss > 0 else -math.inf

    begin = start if start is not None else (xs if direction == "backward" else [])
    model = [xs.index(x) for x in begin]
    score = aic(model)
    steps = [(0, "start", None, score, [xs[i] for i in model])]
    while True:
        moves = []
        if direction != "forward":
            moves += [(aic([i for i in model if i != d]), "drop", d) for d in model]
        if direction != "backward":
            moves += [(aic(sorted([*model, a])), "add", a) for a in range(k) if a not in model]
        if not moves:
            break
        best, action, i = min(moves)
        if not best < score - 1e-7:
            break
        model = [j for j in model if j != i] if action == "drop" else sorted([*model, i])
        score = best
        steps.append((len(steps), action, xs[i], score, [xs[j] for j in model]))
    return df.sparkSession.createDataFrame(
        steps, "step int, action string, term string, aic double, terms array<string>")


def apply_linear(df: DataFrame, coefs: Mapping[str, float], name: str = "prediction") -> DataFrame:
    """Add the value of a published linear formula; the key ``(Intercept)`` is the constant."""
    total = F.lit(float(coefs.get(INTERCEPT, 0.0)))
    for term, b in coefs.items():
        if term != INTERCEPT:
            total = total + F.col(term) * F.lit(float(b))
    return df.withColumn(name, total)
