"""Correlation tests and models against brute force and Spark ML."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelkit.operators import (
    anova, apply_linear, cor_matrix, cor_pvalues, cor_test, cor_with, lasso, ols, quantiles, share, spearman, step_aic, upper_triangle,
)
from panelkit.operators.moments import moments


@pytest.fixture(scope="module")
def sample():
    random.seed(7)
    rows = []
    for _ in range(300):
        a, b, c = random.gauss(0, 1), random.gauss(5, 3), random.gauss(-2, 0.5)
        rows.append((a, b, c, 3 + 2 * a - 0.5 * b + random.gauss(0, 1)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample, "a double, b double, c double, y double").cache()


def test_correlation_test(frame, sample):
    x = np.array(sample)
    want = np.corrcoef(x[:, 0], x[:, 3])[0, 1]
    got = cor_test(frame, "a", "y").first()
    assert got.r == pytest.approx(want) and (got.n, got.df) == (300, 298)
    assert got.t == pytest.approx(want * math.sqrt(298 / (1 - want**2)))
    assert got.low < got.r < got.high and got.p < 1e-20


def test_correlation_test_equals_regression_slope(frame):
    vectors = VectorAssembler(inputCols=["c"], outputCol="features").transform(frame)
    summary = LinearRegression(labelCol="y", solver="normal").fit(vectors).summary
    got = cor_test(frame, "c", "y").first()
    assert got.p == pytest.approx(summary.pValues[0], rel=1e-6)
    assert got.t**2 == pytest.approx(summary.tValues[0] ** 2, rel=1e-6)


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 1.0), (4.0, 4.0)], "x double, y double")
    assert cor_test(df, "x", "y").first().n == 3
    perfect = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert cor_test(perfect, "x", "y").first().r == pytest.approx(1)
    assert cor_test(perfect.limit(1), "x", "y").first().p is None


def test_one_against_all(frame):
    got = [(r.variable, r.r) for r in cor_with(frame, "y", 0.3).collect()]
    assert [g[0] for g in got] == ["a", "b"] or [g[0] for g in got] == ["b", "a"]
    assert abs(got[0][1]) >= abs(got[1][1])


def test_matrix(frame, sample):
    want = np.corrcoef(np.array(sample).T)
    cols = ["a", "b", "c", "y"]
    full = cor_matrix(frame, cols, digits=None).collect()
    assert len(full) == 16
    for r in full:
        assert r.r == pytest.approx(want[r.row - 1, r.col - 1])
    assert upper_triangle(cor_matrix(frame, cols)).count() == 10
    p = {(r.var1, r.var2): r.p for r in cor_pvalues(frame, cols).collect()}
    assert p["a", "a"] == 0 and p["a", "y"] == p["y", "a"] == pytest.approx(cor_test(frame, "a", "y").first().p)


def test_matrix_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 4.5)], "x double, y double")
    strict = {(r.var1, r.var2): r.r for r in cor_matrix(df, ["x", "y"]).collect()}
    assert strict["x", "y"] is None and strict["x", "x"] == 1.0
    assert {(r.var1, r.var2): r.n for r in cor_matrix(df, ["x", "y"], strict=False).collect()}["x", "y"] == 3


def test_rank_correlation_with_ties(spark):
    random.seed(1)
    pairs = [(random.randint(1, 5), random.randint(1, 9)) for _ in range(400)] + [(None, 3)]
    df = spark.createDataFrame(pairs, "x int, y int")
    complete = [p for p in pairs if p[0] is not None]

    def ranks(values):
        return [sum(v < u for v in values) + (sum(v == u for v in values) + 1) / 2 for u in values]

    want = np.corrcoef(ranks([p[0] for p in complete]), ranks([p[1] for p in complete]))[0, 1]
    got = spearman(df, "x", "y").first()
    assert got.rho == pytest.approx(want) and got.n == 400


def test_column_names_of_the_caller_do_not_matter(spark):
    df = spark.createDataFrame([(1.0, 2.0, "p"), (2.0, 1.0, "q"), (4.0, 7.0, "p"), (3.0, 3.0, "q")], "n double, w double, m string")
    want = spearman(df.toDF("a", "b", "c"), "a", "b").first()
    assert spearman(df, "n", "w").first() == want == spearman(df.toDF("times", "value", "c"), "times", "value").first()
    assert anova(df, "n", "m").first() == anova(df.toDF("a", "b", "n"), "a", "n").first()
    assert quantiles(df, "n", [0.5]) == [2.5]
    assert {r.w: (r.n, r.prop) for r in share(df, "m", "n").collect()}[2.0] == (5.0, 0.2)


def test_anova_against_sums(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0, 8.0], "c": [5.0, 5.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)], "g string, y double")
    values = [v for vs in groups.values() for v in vs]
    grand = sum(values) / 9
    between = sum(len(v) * (sum(v) / len(v) - grand) ** 2 for v in groups.values())
    within = sum((x - sum(v) / len(v)) ** 2 for v in groups.values() for x in v)
    got = anova(df, "y", "g").first()
    assert (got.df_between, got.df_within) == (2, 6)
    assert got.ss_between == pytest.approx(between) and got.ss_within == pytest.approx(within)
    assert got.f == pytest.approx((between / 2) / (within / 6)) and 0 < got.p < 1


def test_least_squares_against_spark_ml(frame):
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame)
    model = LinearRegression(labelCol="y", solver="normal").fit(vectors)
    got = {r.term: r for r in ols(frame, "y", ["a", "b", "c"]).collect()}
    for i, term in enumerate(["a", "b", "c"]):
        assert got[term].estimate == pytest.approx(model.coefficients[i], rel=1e-8)
        assert got[term].t == pytest.approx(model.summary.tValues[i], rel=1e-6)
        assert got[term].p == pytest.approx(model.summary.pValues[i], rel=1e-6, abs=1e-12)
    constant = got["(Intercept)"]
    assert constant.estimate == pytest.approx(model.intercept) and constant.t == pytest.approx(model.summary.tValues[3], rel=1e-6)
    assert constant.r2adj == pytest.approx(model.summary.r2adj)


def test_moments_add_up(frame):
    cols = ["a", "b", "y"]
    low, high = moments(frame.where("a < 0"), cols), moments(frame.where("a >= 0"), cols)
    whole, added = moments(frame, cols), low + high
    assert added.n == whole.n and np.allclose(added.mean, whole.mean) and np.allclose(added.cross, whole.cross)


def test_lasso_against_spark_ml(frame):
    """Same penalty, same slopes; Spark ML standardises by the sample deviation, hence the tolerance."""
    lam = 0.3
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame)
    model = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=lam, tol=1e-10, maxIter=1000).fit(vectors)
    got = {r.term: r.estimate for r in lasso(frame, "y", ["a", "b", "c"], [lam], folds=5).collect()}
    for i, term in enumerate(["a", "b", "c"]):
        assert got[term] == pytest.approx(model.coefficients[i], abs=0.01)
    assert got["(Intercept)"] == pytest.approx(model.intercept, abs=0.05)


def test_lasso_chooses_a_small_penalty_and_repeats(frame):
    first = lasso(frame, "y", ["a", "b", "c"]).orderBy("pos").collect()
    again = lasso(frame.repartition(7), "y", ["a", "b", "c"]).orderBy("pos").collect()
    assert [r.estimate for r in first] == pytest.approx([r.estimate for r in again])
    assert {r.term for r in first if r.kept} >= {"a", "b"} and 0 < first[0]["lambda"] < 0.5
    grid = [10 ** (10 - 12 * i / 99) for i in range(100)]
    kept = [r.term for r in lasso(frame, "y", ["a", "b", "c"], grid).collect() if r.kept]
    assert "a" in kept and "b" in kept


def test_steps_against_brute_force(frame, sample):
    x = np.array(sample)

    def aic(cols):
        design = np.column_stack([np.ones(len(x)), *[x[:, i] for i in cols]])
        rss = ((x[:, 3] - design @ np.linalg.lstsq(design, x[:, 3], rcond=None)[0]) ** 2).sum()
        return len(x) * math.log(rss / len(x)) + 2 * (len(cols) + 1)

    best = min((aic(s), s) for k in range(4) for s in itertools.combinations(range(3), k))
    for direction in ("forward", "backward", "both"):
        steps = step_aic(frame, "y", ["a", "b", "c"], direction).orderBy("step").collect()
        assert steps[-1].aic == pytest.approx(best[0])
        assert steps[-1].terms == ["abc"[i] for i in best[1]]
        assert all(later.aic < earlier.aic for earlier, later in zip(steps, steps[1:]))
    assert step_aic(frame, "y", ["a", "b"], "both", start=["a", "b"]).first().terms == ["a", "b"]
    with pytest.raises(ValueError):
        step_aic(frame, "y", ["a"], "sideways")


def test_models_ignore_incomplete_rows(spark, frame):
    holed = frame.unionByName(frame.limit(5).withColumn("a", F.lit(None).cast("double")))
    assert ols(holed, "y", ["a", "b"]).first().n == 300
    with pytest.raises(ValueError):
        moments(holed.where("a is null"), ["a", "b"])


def test_many_predictors_in_one_pass(spark):
    """As wide as the feature master: 34 predictors."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 34))
    y = x[:, 0] * 2 - x[:, 33] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([tuple(map(float, [*r, v])) for r, v in zip(x, y)], ", ".join(f"x{i} double" for i in range(34)) + ", y double")
    fit = {r.term: r.estimate for r in ols(df, "y", [f"x{i}" for i in range(34)]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [fit["(Intercept)"], *[fit[f"x{i}"] for i in range(34)]] == pytest.approx(list(want), abs=1e-8)


def test_formula(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert apply_linear(df, {"(Intercept)": 1.0, "a": 10.0, "b": -1.0}).first().prediction == 18.0
