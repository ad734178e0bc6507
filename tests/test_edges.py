"""Edges and scale of reads, statistics, selection, streams and scratch data."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit import session
from panelkit.functions.tails import f_tail, t_tail
from panelkit.operators import cor_matrix, cor_test, cor_with, lasso, ols, split_outliers, step_aic
from panelkit.operators.models import _descend
from panelkit.operators.moments import moments, pair_moments
from panelkit.operators.ordering import running_total
from panelkit.plans.reports import compare, comparison_heading
from panelkit.sources import extract_links, read_table, read_wide
from panelkit.streaming import latest_weekly, run_weekly, stream_weekly


# ---------------------------------------------------------------- moments

def test_moments_are_stable_far_from_zero(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(5000, 4)) + 1e9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(7)
    m = moments(df, ["a", "b", "c", "d"])
    centred = x - x.mean(axis=0)
    assert m.n == 5000 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.cross, centred.T @ centred, rtol=1e-5, atol=1e-3)


def test_pair_moments_count_where_both_are_present(spark):
    rows = [(1.0, 2.0, None), (2.0, None, 1.0), (3.0, 1.0, 4.0), (4.0, 7.0, 2.0), (None, 3.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pairs = pair_moments(df, ["a", "b", "c"])
    both = [(r[0], r[2]) for r in rows if r[0] is not None and r[2] is not None]
    assert pairs.rows == 5 and pairs.n.tolist() == [[4, 3, 3], [3, 4, 3], [3, 3, 4]]
    assert pairs.correlation()[0, 2] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    strict = cor_matrix(df, ["a", "b"], digits=None)
    assert {r["r"] for r in strict.collect()} == {None}
    assert cor_matrix(df.limit(0), ["a", "b"]).count() == 4


def test_wide_models_read_the_table_once(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 34))
    y = x[:, :5] @ np.arange(1.0, 6) + draw.normal(size=400)
    names = [f"x{i}" for i in range(34)]
    df = spark.createDataFrame([tuple(map(float, [*r, v])) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "y"]))
    got = {r["term"]: r["estimate"] for r in ols(df, "y", names).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert [got["(Intercept)"], *[got[n] for n in names]] == pytest.approx(want.tolist())


# ---------------------------------------------------------------- statistics at the edges

def test_perfect_constant_and_short_correlations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, -3.0 * i, 5.0) for i in range(6)], "a double, b double, c double, k double")
    up, down = cor_test(df, "a", "b").first(), cor_test(df, "a", "c").first()
    assert (up["r"], up["t"], up["p"], up["low"], up["high"]) == (1, math.inf, 0, 1, 1)
    assert (down["r"], down["t"], down["p"], down["low"], down["high"]) == (-1, -math.inf, 0, -1, -1)
    assert cor_test(df, "a", "k").first()["t"] is None and cor_test(df.limit(2), "a", "b").first()["t"] is None


def test_strict_correlations_leave_out_columns_with_gaps(spark):
    df = spark.createDataFrame([(1.0, 1.1, 3.0), (2.0, None, 2.0), (3.0, 3.2, 1.0), (4.0, 3.9, 0.5)], "y double, gap double, whole double")
    assert [r["variable"] for r in cor_with(df, "y").collect()] == ["whole"]
    assert {r["variable"] for r in cor_with(df, "y", strict=False).collect()} == {"gap", "whole"}


def test_aliased_and_constant_terms(spark):
    draw = random.Random(3)
    rows = [(a := draw.random(), a * 2 - 1, draw.random(), 4.0, 3 * a + draw.random()) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, again double, b double, k double, y double")
    full = {r["term"]: r for r in ols(df, "y", ["a", "again", "b", "k"]).collect()}
    plain = {r["term"]: r for r in ols(df, "y", ["a", "b"]).collect()}
    assert full["again"]["estimate"] is full["k"]["estimate"] is full["again"]["p"] is None
    for term in ("(Intercept)", "a", "b"):
        assert full[term]["estimate"] == pytest.approx(plain[term]["estimate"]) and full[term]["p"] == pytest.approx(plain[term]["p"])
        assert full[term]["r2adj"] == pytest.approx(plain[term]["r2adj"])
    steps = step_aic(df, "y", ["a", "again"], "forward").collect()
    assert [s["term"] for s in steps] in ([None, "a"], [None, "again"])
    flat = ols(df.withColumn("y", F.lit(7.0)), "y", ["a"]).first()
    assert flat["r2"] is None and flat["estimate"] == pytest.approx(7)


def test_tails_hold_for_many_degrees_of_freedom():
    normal = math.erfc(0.5 / math.sqrt(2))
    for df in (1e8, 1e10, 1e11, 1e12):
        assert t_tail(0.5, df) == pytest.approx(normal, abs=3e-9)
        assert t_tail(-3.0, df) == pytest.approx(math.erfc(3 / math.sqrt(2)), rel=1e-4)
    assert f_tail(1, 5, 1e12) == pytest.approx(0.4158801869955079, abs=1e-9)   # the chi-square limit with 5 degrees
    assert f_tail(1, 1e8, 1e8) == pytest.approx(0.5, abs=1e-8)
    assert t_tail(2.0, 5) == pytest.approx(0.10193947882) and f_tail(3.5, 2, 10) == pytest.approx(1.7 ** -5)


def test_lasso_by_a_fold_column_and_without_an_end(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(i % 4, float(x), float(2 * x + e)) for i, (x, e) in enumerate(draw.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "fold int, x double, y double")
    got = {r["term"]: r["lambda"] for r in lasso(df, "y", ["x"], [5.0, 0.5, 0.001], fold="fold").collect()}
    assert got["x"] == 0.001
    monkeypatch.setattr("panelkit.operators.models.SWEEPS", 1)
    with pytest.raises(ArithmeticError):
        _descend(np.array([[1.0, 0.9], [0.9, 1.0]]), np.array([1.0, 0.2]), 0.01, np.zeros(2))


# ---------------------------------------------------------------- reads

def test_wide_files_of_different_width_meet_by_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text("County,2020-01-01\nA,1\n")
    (tmp_path / "two.csv").write_text('County,2020-01-02,2020-01-01\nB,"2,000",3\n')
    (tmp_path / "three.csv").write_text("")
    rows = {r["County"]: (r["2020-01-01"], r["2020-01-02"]) for r in read_wide(spark, str(tmp_path), ["County"]).collect()}
    assert rows == {"A": ("1", None), "B": ("3", "2,000")}
    with pytest.raises(ValueError):
        read_wide(spark, str(tmp_path), ["State"])


def test_wide_files_may_begin_with_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("County,2020-01-01\nA,1\n")
    (tmp_path / "b.csv").write_text("\n  \nCounty,2020-01-02\nB,2\n")
    (tmp_path / "c.csv").write_text("\n\n")
    rows = {(r["County"], r["2020-01-01"], r["2020-01-02"]) for r in read_wide(spark, str(tmp_path), ["County"]).collect()}
    assert rows == {("A", "1", None), ("B", None, "2")}


def test_declared_columns_must_match_the_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,a\n1,2\n")
    with pytest.raises(Exception):
        read_table(spark, str(path), "a int, b int").collect()


def test_links_are_read_as_a_parser_reads_them(spark):
    html = ('<a data-href="/no.csv" href="/yes.csv">x</a><a href=/bare.csv>y</a><A class="b" HREF=\'/q.csv?a=1&amp;b=.csv\'>z</A>'
            '<abbr href="/abbr.csv"><a title="href=/t.csv" href="/real.csv">')
    got = [(r["pos"], r["href"]) for r in extract_links(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()]
    assert got == [(0, "/yes.csv"), (1, "/bare.csv"), (2, "/q.csv?a=1&b=.csv"), (3, "/real.csv")]


# ---------------------------------------------------------------- selection, order, headings

def test_outliers_split_keeps_every_row_once(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 9.0), (None, 2.0), ("c", None), (None, 99.0)], "id string, v double")
    for ids in (("id", ["b"]), spark.createDataFrame([("b",), ("b",)], "id string")):
        kept, odd = split_outliers(df, "v", 50, ids)
        assert sorted((str(r["id"]), r["v"]) for r in kept.collect()) == [("None", 2.0), ("a", 1.0)]
        assert odd.count() == 3 and kept.columns == odd.columns == df.columns


def test_running_total_sorts_by_range_once(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = running_total(df, [F.col("v")], F.col("v"), "total")
    assert {r["v"]: r["total"] for r in got.collect()} == {v: v * (v + 1) // 2 for v in range(1000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" not in plan


def test_comparison_names_the_counties(spark):
    assert comparison_heading(["A, XX"]) == "COVID in A, XX" and comparison_heading(["A, XX", "B, YY"]) == "COVID in A, XX and B, YY"
    panel = spark.createDataFrame([("A, XX", dt.date(2020, 1, 1), 1.0)], "NAME string, date date, cases double")
    assert compare(panel, ["A, XX", ""], "cases").first()["heading"] == "COVID in A, XX"


# ---------------------------------------------------------------- streams and scratch data

def test_weekly_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "ts timestamp, state string, new_cases double"
    def run():
        return run_weekly(stream_weekly(spark.readStream.schema(schema).parquet(source)), out, progress)
    def add(rows):
        spark.createDataFrame([(dt.datetime(*d), s, v) for d, s, v in rows], schema).write.mode("append").parquet(source)
    add([((2021, 5, 3), "MN", 1.0), ((2021, 5, 4), "MN", 2.0)])
    assert [tuple(r) for r in run().collect()] == [(dt.date(2021, 5, 2), "MN", 3.0)]
    add([((2020, 6, 10), "MN", 5.0), ((2021, 5, 8), "MN", 4.0)])    # one eleven months late
    want = {(dt.date(2020, 6, 7), "MN", 5.0), (dt.date(2021, 5, 2), "MN", 7.0)}
    assert {tuple(r) for r in run().collect()} == want
    assert {tuple(r) for r in run().collect()} == want              # nothing new: the table stays
    assert latest_weekly(spark, str(tmp_path / "none"), run().schema).count() == 0


def test_scratch_folder_rules(spark, tmp_path):
    assert session.is_one_process("local") and session.is_one_process("local[4]") and not session.is_one_process("local-cluster[2,1,1024]")
    assert session.shared("hdfs://host/warehouse/_scratch") == "hdfs://host/warehouse/_scratch"
    for folder in ("file:/tmp/spark-warehouse/_scratch", "/tmp/warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared(folder)
    path = session.scratch_path(spark, "trial")
    assert path.startswith(session.checkpoint_dir(spark))
    spark.range(3).write.parquet(path)
    session.drop_scratch(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        session.drop_scratch(spark, str(tmp_path))


# ---------------------------------------------------------------- city reports in one pass

def test_city_report_equals_the_single_studies_and_reads_once(spark, tmp_path):
    from panelkit.plans.city import city_report, city_study
    from panelkit.plans.specs import CITY_CATEGORIES

    draw = random.Random(9)
    tables = sorted({(s.tidy or s).table for s in CITY_CATEGORIES.values()})
    labels = ["Estimate!!Total!!Male!!Under 6 years", "Estimate!!Total!!Female!!Bachelor's degree", "Estimate!!Total!!White alone",
              "Estimate!!Median income", "Estimate!!Total!!Male!!65 years and over!!With health insurance coverage"]
    names = [(f"{t}_{k:03d}", draw.choice(labels)) for t in tables for k in range(1, 40)]
    rows = [(str(z), v, draw.choice([None, 1.0, 5.0, 9.0])) for z in range(8) for v, _ in names if draw.random() < 0.9]
    cases = [(str(z), float(z * z % 5), 1.0) for z in range(9)]
    for name, data, schema in (("acs", rows, "GEOID string, variable string, estimate double"),
                               ("cases", cases, "zip string, case_rate double, death_rate double")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    acs, covid = (spark.read.parquet(str(tmp_path / n)) for n in ("acs", "cases"))
    variables = spark.createDataFrame(names, "variable string, label string")
    report = city_report(covid, acs, variables, None, CITY_CATEGORIES, above=4)
    got = {r["measure"]: (r["n"], r["r"]) for r in report.collect()}
    assert len(got) == len({s.name for s in CITY_CATEGORIES.values()})
    for spec in list(CITY_CATEGORIES.values())[::4]:
        one = city_study(covid, acs, variables, None, spec, above=4).first()
        assert got[spec.name][0] == one["n"] and got[spec.name][1] == (None if one["r"] is None else pytest.approx(one["r"])), spec.name
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" Relation [") == 2


def test_subset_shares_sort_once_for_each_chain(spark):
    from panelkit.operators.shares import _chains, subset_cells

    for dims in (["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]):
        found = {frozenset(c[:k]) for c in _chains(dims) for k in range(1, len(c) + 1)}
        assert len(found) == 2 ** len(dims) - 2
    df = spark.range(20).select((F.col("id") % 2).alias("k"), *[(F.col("id") % n).alias(f"d{n}") for n in (2, 3, 5)], F.lit(1.0).alias("v"))
    plan = subset_cells(df, "k", ["d2", "d3", "d5"], "v", "total")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort [") <= 3


def test_near_collinear_terms_are_kept_and_copies_are_not(spark):
    draw = np.random.default_rng(3)
    x, noise, z = draw.normal(size=(3, 5000))
    near = x + 1e-4 * noise
    y = 3000 * x - 3000 * near + z + draw.normal(size=5000) * 0.1
    rows = [tuple(map(float, r)) for r in zip(x, near, z, y, x - near)]
    df = spark.createDataFrame(rows, "x double, near double, z double, y double, gap double").repartition(7)
    fit = {r["term"]: r for r in ols(df.withColumn("again", F.col("x")), "y", ["x", "again", "near", "z", "gap"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(5000), x, near, z]), y, rcond=None)[0]
    assert [fit[t]["estimate"] for t in ("(Intercept)", "x", "near", "z")] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-6)
    assert fit["again"]["estimate"] is None and fit["gap"]["estimate"] is None and fit["z"]["n"] == 5000
    steps = step_aic(df, "y", ["x", "near", "z"], "backward").collect()
    assert sorted(steps[-1]["terms"]) == ["near", "x", "z"]


def test_estimates_keep_their_digits_at_a_condition_of_1e8(spark):
    draw = np.random.default_rng(5)
    u, _ = np.linalg.qr(draw.normal(size=(400, 6)))
    v, _ = np.linalg.qr(draw.normal(size=(6, 6)))
    x = u * 10.0 ** -np.linspace(0, 6, 6) @ v.T * 1e3
    y = x @ np.arange(1, 7) + draw.normal(size=400) * 1e-6
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, [*a, b])) for a, b in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))
    got = [r["estimate"] for r in ols(df.repartition(5), "y", names).orderBy("pos").collect()]
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert got[1:] == pytest.approx(want[1:].tolist(), rel=1e-6)
