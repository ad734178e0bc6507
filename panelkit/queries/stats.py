"""Correlation tests and models."""

from pyspark.sql import DataFrame, functions as F

from panelkit.operators import (
    anova, apply_linear, cor_matrix, cor_pvalues, cor_test, cor_with, lasso, ols, spearman, step_aic, upper_triangle,
)
from panelkit.queries.registry import query, rounded, Tables

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

CUSTOMER_SQL = """per AS (
  SELECT c_custkey, c_acctbal AS balance, count(o_orderkey) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean,
         count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _per_customer(t: Tables) -> DataFrame:
    sums = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    rows = t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.col("c_acctbal").alias("balance"), F.coalesce("n", F.lit(0)).cast("double").alias("n"),
                       "total", "mean", F.coalesce("filled", F.lit(0)).cast("double").alias("filled"))


# Two-sided p of a t statistic with many degrees of freedom, as a sum over the density by Simpson's rule.
T_TAIL = """1 - 2 * (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + power(abs(t) * i / 2000, 2) / v)))
      FROM generate_series(0, 2000) g(i)) * abs(t) / 6000"""


@query("correlation_test", f"""
WITH {CUSTOMER_SQL},
s AS (SELECT corr(balance, total) AS r, count(CASE WHEN balance IS NOT NULL AND total IS NOT NULL THEN 1 END) AS n FROM per),
q AS (SELECT *, CAST(n - 2 AS DOUBLE) AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM s)
SELECT round(r, 6) AS r, n, CAST(v AS BIGINT) AS df, round(t, 6) AS t, round({T_TAIL}, 6) AS p,
       round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high
FROM q""")
def correlation_test(t: Tables) -> DataFrame:
    return rounded(cor_test(_per_customer(t), "balance", "total").select("r", "n", "df", "t", "p", "low", "high"))


@query("strong_correlations", f"""
WITH {CUSTOMER_SQL}, s AS (
  SELECT 'balance' AS variable, corr(balance, total) AS r FROM per UNION ALL SELECT 'n', corr(n, total) FROM per
  UNION ALL SELECT 'mean', corr(mean, total) FROM per UNION ALL SELECT 'filled', corr(filled, total) FROM per)
SELECT variable, round(r, 6) AS r FROM s WHERE abs(r) >= 0.5 AND r <> 1""")
def strong_correlations(t: Tables) -> DataFrame:
    return rounded(cor_with(_per_customer(t).drop("c_custkey"), "total", 0.5))


@query("rank_correlation", """
WITH x AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem),
q AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x),
s AS (SELECT corr(ra, rb) AS rho, count(*) AS n FROM q)
SELECT round(rho, 6) AS rho, n, n - 2 AS df, round(rho * sqrt((n - 2) / (1 - rho * rho)), 4) AS t FROM s""")
def rank_correlation(t: Tables) -> DataFrame:
    return rounded(rounded(spearman(t.lineitem, "l_quantity", "l_discount").select("rho", "n", "df", "t"), 4, "t"))


@query("rank_correlation_prices", """
WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem),
q AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM q""")
def rank_correlation_prices(t: Tables) -> DataFrame:
    """Many distinct values on one side."""
    return rounded(spearman(t.lineitem, "l_quantity", "l_extendedprice").select("rho", "n"))


def _matrix_sql(cell: str, upper: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS row, {j + 1} AS col, '{a}' AS var1, '{b}' AS var2, {cell.format(a=a, b=b)} FROM lineitem"
        for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i <= j or not upper)


@query("correlation_matrix", _matrix_sql("round_even(corr({a}, {b}), 2) AS r", False))
def correlation_matrix(t: Tables) -> DataFrame:
    return cor_matrix(t.lineitem, NUMBERS).drop("n")


@query("correlation_triangle", _matrix_sql("round_even(corr({a}, {b}), 2) AS r", True))
def correlation_triangle(t: Tables) -> DataFrame:
    return upper_triangle(cor_matrix(t.lineitem, NUMBERS)).drop("n")


@query("correlation_pvalues", f"""
WITH m AS ({_matrix_sql("corr({a}, {b}) AS r, count(*) AS n", False)}),
q AS (SELECT *, CAST(n - 2 AS DOUBLE) AS v, CASE WHEN row <> col THEN r * sqrt((n - 2) / (1 - r * r)) END AS t FROM m)
SELECT row, col, var1, var2, n, round(CASE WHEN row = col THEN 0 ELSE {T_TAIL} END, 6) AS p FROM q""")
def correlation_pvalues(t: Tables) -> DataFrame:
    return rounded(cor_pvalues(t.lineitem, NUMBERS).drop("r"))


@query("price_by_priority_anova", """
WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS w FROM orders GROUP BY 1),
a AS (SELECT avg(o_totalprice) AS grand FROM orders),
s AS (SELECT count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within, sum(n * (m - grand) * (m - grand)) AS ss_between,
             sum(w) AS ss_within FROM g, a)
SELECT df_between, df_within, round(ss_between / 1e6, 2) AS ss_between, round(ss_within / 1e9, 2) AS ss_within,
       round((ss_between / df_between) / (ss_within / df_within), 6) AS f FROM s""")
def price_by_priority_anova(t: Tables) -> DataFrame:
    rows = anova(t.orders, "o_totalprice", "o_orderpriority")
    return rows.select("df_between", "df_within", F.round(F.col("ss_between") / 1e6, 2).alias("ss_between"),
                       F.round(F.col("ss_within") / 1e9, 2).alias("ss_within"), F.round("f", 6).alias("f"))


@query("two_group_anova", f"""
WITH x AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS g, o_totalprice AS y FROM orders),
s AS (SELECT corr(g, y) AS r, count(*) AS n FROM x),
q AS (SELECT CAST(n - 2 AS DOUBLE) AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM s)
SELECT CAST(v AS BIGINT) AS df_within, round(t * t, 6) AS f, round({T_TAIL}, 6) AS p FROM q""")
def two_group_anova(t: Tables) -> DataFrame:
    """With two levels F is the square of t, and both have the same p."""
    rows = t.orders.withColumn("g", F.col("o_orderstatus") == "F")
    return rounded(anova(rows, "o_totalprice", "g").select("df_within", "f", "p"))


@query("simple_regression", """
SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""")
def simple_regression(t: Tables) -> DataFrame:
    fit = ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    wide = fit.agg(F.max(F.when(F.col("pos") == 0, F.col("estimate"))).alias("intercept"),
                   F.max(F.when(F.col("pos") == 1, F.col("estimate"))).alias("slope"), F.max("r2").alias("r2"), F.max("n").alias("n"))
    return rounded(rounded(wide, 4, "intercept"))


@query("two_predictor_regression", f"""
WITH {CUSTOMER_SQL},
m AS (SELECT count(*) AS n, avg(n) AS mn, avg(mean) AS mm, avg(total) AS my, var_pop(n) * count(*) AS snn, var_pop(mean) * count(*) AS smm,
        covar_pop(n, mean) * count(*) AS snm, covar_pop(n, total) * count(*) AS sny, covar_pop(mean, total) * count(*) AS smy,
        var_pop(total) * count(*) AS syy FROM per WHERE total IS NOT NULL),
b AS (SELECT *, snn * smm - snm * snm AS det, (sny * smm - smy * snm) / (snn * smm - snm * snm) AS b1,
        (smy * snn - sny * snm) / (snn * smm - snm * snm) AS b2 FROM m),
e AS (SELECT *, (syy - b1 * sny - b2 * smy) AS rss, (syy - b1 * sny - b2 * smy) / (n - 3) AS s2 FROM b)
SELECT 'n' AS term, round(b1, 4) AS estimate, round(sqrt(s2 * smm / det), 4) AS std_error, round(b1 / sqrt(s2 * smm / det), 4) AS t,
       round(1 - rss / syy, 6) AS r2, round(1 - (rss / syy) * (n - 1) / (n - 3), 6) AS r2adj FROM e
UNION ALL
SELECT 'mean', round(b2, 4), round(sqrt(s2 * snn / det), 4), round(b2 / sqrt(s2 * snn / det), 4),
       round(1 - rss / syy, 6), round(1 - (rss / syy) * (n - 1) / (n - 3), 6) FROM e
UNION ALL
SELECT '(Intercept)', round(my - b1 * mn - b2 * mm, 3), round(sqrt(s2 * (1 / n + (mn * mn * smm - 2 * mn * mm * snm + mm * mm * snn) / det)), 4),
       round((my - b1 * mn - b2 * mm) / sqrt(s2 * (1 / n + (mn * mn * smm - 2 * mn * mm * snm + mm * mm * snn) / det)), 4),
       round(1 - rss / syy, 6), round(1 - (rss / syy) * (n - 1) / (n - 3), 6) FROM e""")
def two_predictor_regression(t: Tables) -> DataFrame:
    fit = ols(_per_customer(t), "total", ["n", "mean"])
    digits = F.when(F.col("pos") == 0, F.round("estimate", 3)).otherwise(F.round("estimate", 4))
    return fit.select("term", digits.alias("estimate"), F.round("std_error", 4).alias("std_error"), F.round("t", 4).alias("t"),
                      F.round("r2", 6).alias("r2"), F.round("r2adj", 6).alias("r2adj"))


@query("near_collinear_predictors", """
WITH x AS (SELECT l_extendedprice AS y, l_quantity AS q, CAST((l_orderkey * 7 + l_linenumber * 13) % 101 - 50 AS DOUBLE) AS e FROM lineitem),
m AS (SELECT count(*) AS n, avg(q) AS mq, avg(e) AS me, avg(y) AS my, var_pop(q) * count(*) AS sqq, var_pop(e) * count(*) AS see,
        covar_pop(q, e) * count(*) AS sqe, covar_pop(q, y) * count(*) AS sqy, covar_pop(e, y) * count(*) AS sey, var_pop(y) * count(*) AS syy FROM x),
b AS (SELECT *, sqq * see - sqe * sqe AS det, (sqy * see - sey * sqe) / (sqq * see - sqe * sqe) AS bq, (sey * sqq - sqy * sqe) / (sqq * see - sqe * sqe) AS be FROM m),
f AS (SELECT *, (syy - bq * sqy - be * sey) / (n - 3) AS s2, 0.0001 AS h FROM b)
SELECT 'q' AS term, round((bq - be / h) / 1000, 3) AS estimate, round(sqrt(s2 * (see + sqq / h / h + 2 * sqe / h) / det) / 1000, 4) AS std_error FROM f
UNION ALL SELECT 'near', round(be / h / 1000, 3), round(sqrt(s2 * sqq / det) / h / 1000, 4) FROM f""")
def near_collinear_predictors(t: Tables) -> DataFrame:
    """A predictor and the same with a ten-thousandth of noise: both are estimated. The SQL takes the noise for a predictor of
    its own, which is the same model without the loss of digits."""
    noise = (F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13, F.lit(101)) - 50).cast("double")
    rows = t.lineitem.select("l_extendedprice", F.col("l_quantity").cast("double").alias("q"), noise.alias("e"))
    fit = ols(rows.withColumn("near", F.col("q") + F.col("e") * 0.0001), "l_extendedprice", ["q", "near"])
    return fit.filter("pos > 0").select("term", F.round(F.col("estimate") / 1000, 3).alias("estimate"), F.round(F.col("std_error") / 1000, 4).alias("std_error"))


MODEL_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "late"]


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber",
                             F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("late"))


@query("lasso_terms")
def lasso_terms(t: Tables) -> DataFrame:
    return rounded(lasso(_lines(t), "l_extendedprice", MODEL_COLUMNS), 4)


@query("lasso_one_term", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sd,
                  covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS c FROM lineitem),
b AS (SELECT *, CASE WHEN abs(c) > 5000 THEN (c - 5000 * sign(c)) / sd ELSE 0 END AS slope FROM m)
SELECT 'l_quantity' AS term, round(slope, 4) AS estimate, slope <> 0 AS kept FROM b
UNION ALL SELECT '(Intercept)', round(my - slope * mx, 3), true FROM b""")
def lasso_one_term(t: Tables) -> DataFrame:
    """With one predictor and one penalty the solution is a shrunken slope."""
    fit = lasso(t.lineitem, "l_extendedprice", ["l_quantity"], [5000.0])
    shown = F.when(F.col("pos") == 0, F.round("estimate", 3)).otherwise(F.round("estimate", 4))
    return fit.select("term", shown.alias("estimate"), "kept")


LASSO_PENALTIES = [2.0, 33.0, 60.0]


def _two_term_lasso(penalty: float) -> str:
    """All nine pairs of signs; the one whose solution has these signs, and leaves the others' slopes at the bound, is it."""
    return f"""
SELECT {penalty} AS penalty, b1 / s1 AS q, b2 / s2 AS near, my - b1 / s1 * m1 - b2 / s2 * m2 AS constant FROM (
  SELECT *, CASE WHEN e1 <> 0 AND e2 <> 0 THEN ((c1 - {penalty} * e1) - rho * (c2 - {penalty} * e2)) / (1 - rho * rho) WHEN e1 <> 0 THEN c1 - {penalty} * e1 ELSE 0 END AS b1,
    CASE WHEN e1 <> 0 AND e2 <> 0 THEN ((c2 - {penalty} * e2) - rho * (c1 - {penalty} * e1)) / (1 - rho * rho) WHEN e2 <> 0 THEN c2 - {penalty} * e2 ELSE 0 END AS b2
  FROM m, (VALUES (-1), (0), (1)) AS x(e1), (VALUES (-1), (0), (1)) AS y(e2))
WHERE sign(b1) = e1 AND sign(b2) = e2 AND (e1 <> 0 OR abs(c1 - rho * b2) <= {penalty}) AND (e2 <> 0 OR abs(c2 - rho * b1) <= {penalty})"""


@query("lasso_two_terms", f"""
WITH x AS (SELECT l_quantity * (1 + l_linenumber % 3) + 100 * l_tax AS y, l_quantity AS a, l_quantity * (l_linenumber % 3) AS b FROM lineitem),
m AS (SELECT avg(a) AS m1, avg(b) AS m2, avg(y) AS my, stddev_pop(a) AS s1, stddev_pop(b) AS s2, corr(a, b) AS rho,
        covar_pop(a, y) / stddev_pop(a) AS c1, covar_pop(b, y) / stddev_pop(b) AS c2 FROM x),
f AS ({" UNION ALL ".join(_two_term_lasso(p) for p in LASSO_PENALTIES)})
SELECT penalty, round(q, 4) AS q, round(near, 4) AS near, round(constant, 2) AS constant FROM f""")
def lasso_two_terms(t: Tables) -> DataFrame:
    """Two correlated predictors, at several penalties: both kept, one dropped, none kept."""
    y = F.col("l_quantity") * (1 + F.col("l_linenumber") % 3) + 100 * F.col("l_tax")
    rows = t.lineitem.select(y.alias("y"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_quantity") * (F.col("l_linenumber") % 3)).cast("double").alias("near"))
    fits = []
    for penalty in LASSO_PENALTIES:
        fit = lasso(rows, "y", ["q", "near"], [penalty]).groupBy().pivot("term", ["(Intercept)", "q", "near"]).agg(F.first("estimate"))
        fits.append(fit.select(F.lit(penalty).alias("penalty"), F.round("q", 4).alias("q"), F.round("near", 4).alias("near"), F.round("(Intercept)", 2).alias("constant")))
    return fits[0].unionByName(fits[1]).unionByName(fits[2])


@query("stepwise_two_terms", """
WITH m AS (SELECT count(*) AS n, var_pop(l_extendedprice) AS yy, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb,
  covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS b_y
  FROM lineitem),
k AS (SELECT n * ln(yy) + 2 AS k0, n * ln(yy - ay * ay / aa) + 4 AS ka, n * ln(yy - b_y * b_y / bb) + 4 AS kb,
  n * ln(yy - (ay * (ay * bb - b_y * ab) + b_y * (b_y * aa - ay * ab)) / (aa * bb - ab * ab)) + 6 AS kab FROM m)
SELECT 0 AS step, 'start' AS action, NULL AS term, round(k0, 3) AS aic FROM k
UNION ALL SELECT 1, 'add', CASE WHEN ka <= kb THEN 'l_quantity' ELSE 'l_discount' END, round(least(ka, kb), 3) FROM k
  WHERE least(ka, kb) < k0
UNION ALL SELECT 2, 'add', CASE WHEN ka <= kb THEN 'l_discount' ELSE 'l_quantity' END, round(kab, 3) FROM k
  WHERE least(ka, kb) < k0 AND kab < least(ka, kb)""")
def stepwise_two_terms(t: Tables) -> DataFrame:
    """With two candidates all four models can be written down."""
    steps = step_aic(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], "forward")
    return rounded(steps.drop("terms"), 3)


def _subset_sql(source: str, y: str, xs: list[str]) -> str:
    """CTEs ``fits(mask, aic)`` of all models: each set of predictors is projected out of its predecessor's moments."""
    names = [*xs, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    first = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS c{i}_{j}" for i, j in pairs)
    parts = [f"s0 AS (SELECT count(*) AS n, {first} FROM {source})"]
    for mask in range(1, 1 << len(xs)):
        out = mask.bit_length() - 1
        c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
        cells = ", ".join(f"{c(i, j)} - {c(i, out)} * {c(j, out)} / {c(out, out)} AS {c(i, j)}"
                          for i, j in pairs if not {i, j} & {k for k in range(len(xs)) if mask >> k & 1})
        parts.append(f"s{mask} AS (SELECT n, {cells} FROM s{mask ^ 1 << out})")
    last = len(xs)
    fits = " UNION ALL ".join(f"SELECT {mask} AS mask, n * ln(c{last}_{last}) + {2 * (mask.bit_count() + 1)} AS aic FROM s{mask}"
                              for mask in range(1 << len(xs)))
    return ", ".join([*parts, f"fits AS ({fits})"])


def _steps_sql(source: str, y: str, xs: list[str], moves: str, start: int) -> str:
    """The steps of a selection over all models, for as many steps as there can be between two of them."""
    allowed = {"backward": "t.mask < f.mask", "forward": "t.mask > f.mask", "both": "t.mask <> f.mask"}[moves]
    parts = [f"p0 AS (SELECT 0 AS step, CAST(NULL AS INT) AS bit, mask, aic FROM fits WHERE mask = {start})"]
    for k in range(1, 2 * len(xs) + 1):
        parts.append(f"""p{k} AS (SELECT f.step + 1 AS step, xor(t.mask, f.mask) AS bit, t.mask, t.aic FROM p{k - 1} f JOIN fits t
          ON bit_count(xor(t.mask, f.mask)) = 1 AND {allowed} AND t.aic < f.aic - 1e-7 ORDER BY t.aic LIMIT 1)""")
    path = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(2 * len(xs) + 1))
    named = "CASE bit " + " ".join(f"WHEN {1 << i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
    terms = "concat_ws(',', " + ", ".join(f"CASE WHEN mask & {1 << i} > 0 THEN '{x}' END" for i, x in enumerate(xs)) + ")"
    return f"""WITH {_subset_sql(source, y, xs)}, {", ".join(parts)}, path AS ({path})
SELECT step, CASE WHEN bit IS NULL THEN 'start' WHEN mask & bit > 0 THEN 'add' ELSE 'drop' END AS action, {named} AS term,
       round(aic, 4) AS aic, {terms} AS terms FROM path"""


LINES_SQL = """(SELECT l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS late FROM lineitem)"""


def _steps(t: Tables, direction: str, start: list[str] | None = None) -> DataFrame:
    steps = step_aic(_lines(t), "l_extendedprice", MODEL_COLUMNS, direction, start)
    return rounded(steps.withColumn("terms", F.array_join("terms", ",")), 4)


@query("stepwise_terms", _steps_sql(LINES_SQL, "l_extendedprice", MODEL_COLUMNS, "both", 0))
def stepwise_terms(t: Tables) -> DataFrame:
    return _steps(t, "both")


@query("forward_terms", _steps_sql(LINES_SQL, "l_extendedprice", MODEL_COLUMNS, "forward", 0))
def forward_terms(t: Tables) -> DataFrame:
    return _steps(t, "forward")


@query("backward_terms", _steps_sql(LINES_SQL, "l_extendedprice", MODEL_COLUMNS, "backward", 31))
def backward_terms(t: Tables) -> DataFrame:
    return _steps(t, "backward")


@query("stepwise_from_full", _steps_sql(LINES_SQL, "l_extendedprice", MODEL_COLUMNS, "both", 31))
def stepwise_from_full(t: Tables) -> DataFrame:
    """Both directions, beginning with all predictors."""
    return _steps(t, "both", MODEL_COLUMNS)


@query("perfect_correlation", f"""
WITH {CUSTOMER_SQL}, s AS (SELECT count(*) AS n FROM per WHERE balance IS NOT NULL)
SELECT -1.0 AS r, n, n - 2 AS df, true AS t_below_all, 0.0 AS p, -1.0 AS low, -1.0 AS high FROM s""")
def perfect_correlation(t: Tables) -> DataFrame:
    """A column against its own negative: t is infinite, p is 0, and the interval is a point."""
    rows = _per_customer(t).withColumn("negative", -F.col("balance"))
    test = cor_test(rows, "balance", "negative")
    return test.select("r", "n", "df", (F.col("t") == F.lit(float("-inf"))).alias("t_below_all"), "p", "low", "high")


@query("aliased_predictor", """
WITH m AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
  regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem)
SELECT 0 AS pos, '(Intercept)' AS term, round(a, 3) AS estimate, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS r2adj FROM m
UNION ALL SELECT 1, 'l_quantity', round(b, 3), round(1 - (1 - r2) * (n - 1) / (n - 2), 6) FROM m
UNION ALL SELECT 2, 'again', NULL, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) FROM m""")
def aliased_predictor(t: Tables) -> DataFrame:
    """A predictor that repeats another has no estimate and costs no degree of freedom."""
    rows = t.lineitem.withColumn("again", F.col("l_quantity") * 3 + 1)
    fit = ols(rows, "l_extendedprice", ["l_quantity", "again"])
    return rounded(rounded(fit.select("pos", "term", "estimate", "r2adj"), 3, "estimate"), 6, "r2adj")


PENALTIES = [8000.0, 4000.0, 1000.0, 100.0, 1.0]


@query("lasso_chosen_penalty", f"""
WITH lines AS (SELECT l_orderkey % 10 AS fold, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
grid AS (SELECT unnest({PENALTIES}) AS lam),
train AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd, covar_pop(x, y) / stddev_pop(x) AS c
  FROM lines l JOIN (SELECT DISTINCT fold FROM lines) f ON l.fold <> f.fold GROUP BY f.fold),
slopes AS (SELECT fold, lam, mx, my, sign(c) * greatest(abs(c) - lam, 0) / sd AS b FROM train, grid),
errors AS (SELECT lam, sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS e FROM lines JOIN slopes USING (fold) GROUP BY lam),
best AS (SELECT lam FROM errors ORDER BY round(e, -3), lam DESC LIMIT 1),
m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd, covar_pop(x, y) / stddev_pop(x) AS c FROM lines),
s AS (SELECT lam, mx, my, sign(c) * greatest(abs(c) - lam, 0) / sd AS b FROM m, best)
SELECT 'l_quantity' AS term, round(b, 4) AS estimate, b <> 0 AS kept, lam AS lambda FROM s
UNION ALL SELECT '(Intercept)', round(my - b * mx, 3), true, lam FROM s""")
def lasso_chosen_penalty(t: Tables) -> DataFrame:
    """The penalty chosen over folds that a column names; of equally good ones (all that leave no slope) the first, largest."""
    rows = t.lineitem.withColumn("fold", F.col("l_orderkey") % 10)
    fit = lasso(rows, "l_extendedprice", ["l_quantity"], PENALTIES, fold="fold")
    shown = F.when(F.col("pos") == 0, F.round("estimate", 3)).otherwise(F.round("estimate", 4))
    return fit.select("term", shown.alias("estimate"), "kept", "lambda")


@query("linear_formula", """
SELECT l_orderkey, l_linenumber, round(1000 + 1500.5 * l_quantity - 798.1 * l_discount + 180.8 * l_tax, 4) AS price FROM lineitem""")
def linear_formula(t: Tables) -> DataFrame:
    coefs = {"(Intercept)": 1000.0, "l_quantity": 1500.5, "l_discount": -798.1, "l_tax": 180.8}
    return rounded(apply_linear(t.lineitem, coefs, "price").select("l_orderkey", "l_linenumber", "price"), 4, "price")
