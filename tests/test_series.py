"""Differences, rolling means and the composite panel."""

import datetime as dt

from hypothesis import given, settings, strategies as st
import pytest
from pyspark.sql import functions as F

from panelkit.operators import daily_new, melt_panel, weekly_totals
from panelkit.plans import build_panel, build_snapshot

DAY = dt.date(2020, 3, 1)
KEYS = ["county_name", "state"]


def series(spark, values, name="A"):
    rows = [(name, "IN", DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "county_name string, state string, date date, cases double")


def result(df, *cols):
    return [tuple(r) for r in df.orderBy("county_name", "date").select(*cols).collect()]


def test_first_row_is_compared_with_zero(spark):
    got = result(daily_new(series(spark, [3.0, 5.0, 9.0]), KEYS, "date", "cases"), "new_cases", "moving_7_day_avg")
    assert got == [(3.0, None), (2.0, None), (4.0, None)]


def test_missing_value_is_not_zero(spark):
    got = result(daily_new(series(spark, [3.0, None, 9.0, 10.0]), KEYS, "date", "cases"), "new_cases")
    assert got == [(3.0,), (None,), (None,), (1.0,)]


def test_clamp_after_keeps_the_mean_of_raw_changes(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 4.0]  # a correction of -2 on day seven
    frame = series(spark, values)
    after = result(daily_new(frame, KEYS, "date", "cases", "after"), "new_cases", "moving_7_day_avg")
    before = result(daily_new(frame, KEYS, "date", "cases", "before"), "new_cases", "moving_7_day_avg")
    none = result(daily_new(frame, KEYS, "date", "cases", "none"), "new_cases", "moving_7_day_avg")
    assert after[-1] == (0.0, pytest.approx(4 / 7))
    assert before[-1] == (0.0, pytest.approx(6 / 7))
    assert none[-1] == (-2.0, pytest.approx(4 / 7))
    with pytest.raises(ValueError):
        daily_new(frame, KEYS, "date", "cases", "never")


def test_mean_counts_rows_not_days(spark):
    rows = [("A", "IN", DAY + dt.timedelta(days=10 * i), float(i + 1)) for i in range(8)]
    frame = spark.createDataFrame(rows, "county_name string, state string, date date, cases double")
    got = result(daily_new(frame, KEYS, "date", "cases"), "moving_7_day_avg")
    assert got[5] == (None,) and got[6] == (1.0,) and got[7] == (1.0,)


def test_row_order_does_not_matter(spark):
    frame = series(spark, [1.0, 4.0, 9.0, 16.0]).orderBy(F.desc("date")).repartition(3)
    assert result(daily_new(frame, KEYS, "date", "cases"), "new_cases") == [(1.0,), (3.0,), (5.0,), (7.0,)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=20))
def test_unclamped_changes_add_up_to_the_last_count(spark, values):
    frame = series(spark, [float(v) for v in values])
    total = daily_new(frame, KEYS, "date", "cases", "none").agg(F.sum("new_cases")).first()[0]
    assert total == values[-1]


def test_empty_series(spark):
    assert daily_new(series(spark, []), KEYS, "date", "cases").count() == 0


def test_weeks(spark):
    rows = [("IN", DAY + dt.timedelta(days=i), 1.0) for i in range(22)]
    weeks = weekly_totals(spark.createDataFrame(rows, "state string, date date, new_cases double"))
    got = [(str(r.week), r.state_new_cases, r.moving_3wk_avg) for r in weeks.orderBy("week").collect()]
    assert got == [("2020-03-01", 7.0, None), ("2020-03-08", 7.0, None), ("2020-03-15", 7.0, 7.0), ("2020-03-22", 1.0, 5.0)]


def wide_inputs(spark):
    cols = "countyFIPS string, `County Name` string, State string, StateFIPS string, `2020-03-01` string, `2020-03-02` string"
    cases = spark.createDataFrame([
        ("1", "Lac Qui Parle County", "MN", "27", "1,000", "1,200"),
        ("2", "Cook County", "IL", "17", "5", "4"),
        ("0", "Statewide Unallocated", "IL", "17", "7", "9"),
        ("3", "Other County", "TX", "48", "1", "2")], cols)
    deaths = spark.createDataFrame([
        ("1", "Lac Qui Parle County", "MN", "27", "10", "12"), ("2", "Cook County", "IL", "17", "0", "1"),
        ("0", "Statewide Unallocated", "IL", "17", "0", "0")], cols)
    pop = spark.createDataFrame([
        (1.0, "Lac qui Parle County", "MN", 10000.0), (2.0, "Cook County", "IL", 0.0), (0.0, "Statewide Unallocated", "IL", 0.0)],
        "countyFIPS double, `County Name` string, State string, population double")
    return cases, deaths, pop


def test_build_panel(spark):
    rows = {(r.county_name, str(r.date)): r for r in build_panel(*wide_inputs(spark)).collect()}
    assert set(rows) == {("Lac qui Parle County", "2020-03-01"), ("Lac qui Parle County", "2020-03-02"),
                         ("Cook County", "2020-03-01"), ("Cook County", "2020-03-02")}
    lac = rows["Lac qui Parle County", "2020-03-02"]
    assert (lac.cases, lac.new_cases, lac.NAME, lac.name_short) == (
        1200.0, 200.0, "Lac qui Parle County, Minnesota", "Lac qui Parle County, MN")
    # the two name spellings meet for population, but deaths keep the file's spelling repaired as well
    assert lac.case_rate == pytest.approx(12000.0) and lac.death_rate == pytest.approx(120.0)
    cook = rows["Cook County", "2020-03-02"]
    assert (cook.new_cases, cook.case_rate) == (0.0, None)


def test_build_panel_from_numbers_and_a_shorter_deaths_file(spark):
    cols = "`County Name` string, State string, `2020-03-01` double, `2020-03-02` double"
    cases = spark.createDataFrame([("A", "IN", 1.0, 12.5), ("B", "IN", 3.0, 4.0)], cols)
    deaths = spark.createDataFrame([("A", "IN", 1.0)], "`County Name` string, State string, `2020-03-02` double")
    pop = spark.createDataFrame([("A", "IN", 100.0)], "`County Name` string, State string, population double")
    got = {(r.county_name, r.date.day): (r.cases, r.deaths, r.new_cases, r.population) for r in build_panel(cases, deaths, pop).collect()}
    assert got == {("A", 1): (1.0, None, 1.0, 100.0), ("A", 2): (12.5, 1.0, 11.5, 100.0),
                   ("B", 1): (3.0, None, 3.0, None), ("B", 2): (4.0, None, 1.0, None)}


def test_build_panel_with_unallocated_and_all_states(spark):
    panel = build_panel(*wide_inputs(spark), states=None, include_unallocated=True)
    names = {r.county_name for r in panel.collect()}
    assert names == {"Lac qui Parle County", "Cook County", "Statewide Unallocated", "Other County"}


def test_build_snapshot(spark):
    rows = {r.County: r for r in build_snapshot(*wide_inputs(spark)).collect()}
    assert set(rows) == {"Lac Qui Parle County", "Cook County", "Statewide Unallocated"}
    cook = rows["Cook County"]
    assert (cook.NAME, cook.Cases, cook.Deaths, cook.case_fatality, cook.case_rate) == ("Cook County, Illinois", 4.0, 1.0, 25.0, None)


def test_melt_inverts_pivot(spark):
    long = spark.createDataFrame([(k, f"2020-03-0{d}", str(d * 10)) for k in "ab" for d in (1, 2, 3)], "k string, day string, v string")
    wide = long.groupBy("k").pivot("day").agg(F.first("v"))
    back = melt_panel(wide, ["k"], "v").select("k", F.col("date").cast("string").alias("day"), "v")
    assert back.exceptAll(long).count() == 0 and back.count() == 6


def test_melt_reads_other_date_names(spark):
    wide = spark.createDataFrame([("a", "1")], "k string, `1/22/20` string")
    assert str(melt_panel(wide, ["k"], "v", "M/d/yy").first().date) == "2020-01-22"
