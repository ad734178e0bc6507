"""Scalar helpers on hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.functions import (
    band, canonical, clean_number, code_list, decensor, extract_or_null, flag, group_of, half_even, label_depth, last_part,
    long_date, number_text, parse_us_date, per_capita, range_midpoint, ratio, signif, sum_strict, sunday_week, title_name,
)
from panelkit.functions.tails import beta_area, f_tail, t_tail


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v")).alias("o")).collect()]


def test_clean_number(spark):
    got = column(spark, ["6,714", "12\t", " 5 ", "n/a", None, "-5", "1.5", ""], "string", clean_number)
    assert got == [6714.0, 12.0, 5.0, None, None, 5.0, 15.0, None]


def test_clean_number_keeps_symbols_that_are_no_punctuation(spark):
    assert column(spark, ["1,2-3.4", "$5"], "string", clean_number) == [1234.0, None]


def test_decensor(spark):
    assert column(spark, ["<=5", "17", "x", None], "string", lambda c: decensor(c, "<=5", 5)) == [5.0, 17.0, None, None]


def test_rounding_goes_to_even(spark):
    assert column(spark, [2.5, 3.5, -2.5], "double", half_even) == [2.0, 4.0, -2.0]


def test_signif(spark):
    got = column(spark, [123456.0, 0.00123456, 0.0, -98764.0, None], "double", lambda c: signif(c, 4))
    assert got == [123500.0, pytest.approx(0.001235), 0.0, -98760.0, None]


def test_ratio_and_rates_without_divisor(spark):
    assert column(spark, [0.0, None, 4.0], "double", lambda c: ratio(F.lit(2), c)) == [None, None, 0.5]
    assert column(spark, [0.0, 50.0], "double", lambda c: per_capita(F.lit(1), c)) == [None, 2000.0]


def test_sum_strict(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    assert dict(rows.groupBy("k").agg(sum_strict("v")).collect()) == {"a": None, "b": 5.0}


def test_range_midpoint(spark):
    got = column(spark, ["1,000 - 1,999", "5-10", "12", None], "string", range_midpoint)
    assert got == [1499.5, 7.5, None, None]


def test_number_text(spark):
    assert column(spark, [12.0, 0.125, 10.5, None, 12345678.9], "double", number_text) == ["12", "0.12", "10.5", None, "12345678.9"]
    assert column(spark, [100.0, 2.5], "double", lambda c: number_text(c, 0)) == ["100", "2"]


def test_labels(spark):
    labels = ["Estimate!!Total!!Male!!Under 6 years", "Estimate!!Total", "Plain"]
    assert column(spark, labels, "string", label_depth) == [3, 1, 0]
    assert column(spark, labels, "string", last_part) == ["Under 6 years", "Total", "Plain"]
    assert column(spark, ["new_cases"], "string", title_name) == ["New Cases"]
    assert column(spark, ["Lac Qui Parle County"], "string", lambda c: canonical(c, {"Lac Qui Parle": "Lac qui Parle"})) == [
        "Lac qui Parle County"]


def test_extract_or_null(spark):
    assert column(spark, ["a12", "b", None], "string", lambda c: extract_or_null(c, r"(\d+)")) == ["12", None, None]


def test_weeks_start_on_sunday(spark):
    days = [dt.date(2020, 3, 1), dt.date(2020, 3, 7), dt.date(2020, 3, 8)]  # Sunday, Saturday, Sunday
    assert column(spark, days, "date", sunday_week) == [dt.date(2020, 3, 1), dt.date(2020, 3, 1), dt.date(2020, 3, 8)]


def test_dates_in_words_and_digits(spark):
    assert column(spark, [dt.date(2020, 1, 2)], "date", long_date) == ["January 02, 2020"]
    assert column(spark, ["January 22, 2020", "nothing"], "string", parse_us_date) == [dt.date(2020, 1, 22), None]
    got = column(spark, ["1/22/20", "4/5/95", "7/4/68", "7/4/69"], "string", lambda c: parse_us_date(c, "M/d/yy"))
    assert [d.year for d in got] == [2020, 1995, 2068, 1969]


def test_bands(spark):
    assert column(spark, [0.4, 0.5, 0.7, None], "double", lambda c: band(c, [(0.5, "low"), (0.65, "medium")], "high")) == [
        "low", "medium", "high", None]
    assert column(spark, ["a", "x", None], "string", lambda c: group_of(c, {"A": ["a"]}, "other")) == ["A", "other", None]
    assert column(spark, ["n", "y", None], "string", lambda c: flag(c, "n")) == ["No", "Yes", None]
    assert code_list("C24060", range(2, 4), 10) == ["C24060_002", "C24060_003", "C24060_010"]


def test_tail_areas_match_printed_tables():
    assert t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_tail(12.70620474, 1) == pytest.approx(0.05, abs=1e-8)
    assert f_tail(3.48, 4, 10) == pytest.approx(0.05, abs=2e-4)
    assert f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert beta_area(0.5, 2, 2) == pytest.approx(0.5)
    assert t_tail(0, 5) == pytest.approx(1)
