"""Bulletins, map rows and the weekly stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.operators import at_date, at_latest, split_unallocated
from panelkit.plans import (
    compare, daily_bulletin, last_published_week, map_layer, profile, publish_gate, stacked_shares, unallocated_table, weekly_bulletins,
)
from panelkit.plans.reports import NO_UPDATE_DAILY, NO_UPDATE_WEEKLY
from panelkit.streaming import run_weekly, stream_weekly

SUNDAY = dt.date(2021, 5, 2)
PANEL = ("county_name string, state string, date date, cases double, deaths double, case_rate double, death_rate double, "
         "new_cases double, moving_7_day_avg double, avg_7_day_rate double")


def panel(spark, rows):
    """``(county, state, date, new_cases, mean)`` with the other columns filled in."""
    return spark.createDataFrame([(c, s, d, 100.0, 3.0, 12.345, 1.0, n, m, 0.126) for c, s, d, n, m in rows], PANEL)


def weeks_panel(spark, weeks):
    """Weekly totals per state as one row on the Wednesday of each week."""
    rows = [("A", state, SUNDAY + dt.timedelta(days=7 * i + 3), float(n), None)
            for state, values in weeks.items() for i, n in enumerate(values)]
    return panel(spark, rows)


def posts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def post_for(d):
    return f"New Weekly Reported Cases by State for {d:%B %d, %Y} (3-week Moving Average in Parentheses)"


def test_daily_bulletin(spark):
    d = dt.date(2021, 5, 17)
    df = panel(spark, [("A", "OH", d, 3.0, 2.4), ("B", "OH", d, 4.0, 2.2), ("A", "IN", d, 0.0, 1.5), ("A", "IN", d - dt.timedelta(days=1), 9.0, 9.0)])
    got = daily_bulletin(df).first()
    assert got.date == d
    assert got.text == ("Daily Newly Reported Cases by State for May 17, 2021 (7-day Moving Average in Parentheses)\n\n"
                        "IN: Not Reported (2)\nOH: 7 (5)")
    assert publish_gate(df, "2021-05-18").first().text == got.text
    late = publish_gate(df, dt.date(2021, 5, 20)).first()
    assert (late.fresh, late.text) == (False, NO_UPDATE_DAILY)


def test_missing_mean_leaves_no_text(spark):
    assert daily_bulletin(panel(spark, [("A", "OH", SUNDAY, 3.0, None)])).first().text is None


def test_mark_reads_only_bulletins(spark):
    df = posts(spark, post_for(dt.date(2021, 5, 12)), "Daily Newly Reported Cases by State for May 01, 2021 (7-day",
               "RT New Weekly Reported Cases by State for June 20, 2021 (3-week", "New and nice")
    assert last_published_week(df).first().mark == dt.date(2021, 5, 9)
    assert last_published_week(posts(spark, "hello")).first().mark is None


def test_weekly_bulletins_after_the_mark(spark):
    df = weeks_panel(spark, {"IN": [7, 7, 14, 0], "OH": [0, 0, 0, 3]})
    got = {r.week: r.text for r in weekly_bulletins(df, posts(spark, post_for(SUNDAY + dt.timedelta(days=8)))).collect()}
    assert set(got) == {SUNDAY + dt.timedelta(days=14), SUNDAY + dt.timedelta(days=21)}
    assert got[SUNDAY + dt.timedelta(days=14)] == (
        "New Weekly Reported Cases by State for May 16, 2021 (3-week Moving Average in Parentheses)\n\n"
        "IN: 14 (9)\nOH: No longer reporting")
    assert got[SUNDAY + dt.timedelta(days=21)].endswith("\n\nIN: Not Reported (7)\nOH: 3 (1)")


def test_series_stops_at_the_first_empty_week_after_a_good_one(spark):
    df = weeks_panel(spark, {"IN": [1, 1, 1, 5, 0, 6], "OH": [1, 1, 1, 5, 0, 6]})
    got = weekly_bulletins(df, posts(spark, post_for(SUNDAY + dt.timedelta(days=7)))).collect()
    assert sorted(r.week for r in got) == [SUNDAY + dt.timedelta(days=14), SUNDAY + dt.timedelta(days=21)]


def test_first_week_empty_gives_the_no_update_text_and_goes_on(spark):
    df = weeks_panel(spark, {"IN": [1, 1, 0, 5, 6], "OH": [1, 1, 0, 5, 6]})
    got = {r.week: r.text for r in weekly_bulletins(df, posts(spark, post_for(SUNDAY + dt.timedelta(days=7)))).collect()}
    assert got[SUNDAY + dt.timedelta(days=14)] == NO_UPDATE_WEEKLY and len(got) == 3
    assert "IN: 5 (2)" in got[SUNDAY + dt.timedelta(days=21)]


def test_two_empty_weeks_at_the_start_stop_the_series(spark):
    df = weeks_panel(spark, {"IN": [1, 1, 0, 0, 6]})
    got = weekly_bulletins(df, posts(spark, post_for(SUNDAY + dt.timedelta(days=7)))).collect()
    assert [(r.week, r.text) for r in got] == [(SUNDAY + dt.timedelta(days=14), NO_UPDATE_WEEKLY)]


def test_nothing_new(spark):
    df = weeks_panel(spark, {"IN": [1, 1]})
    got = weekly_bulletins(df, posts(spark, post_for(SUNDAY + dt.timedelta(days=30)))).collect()
    assert [(r.week, r.text) for r in got] == [(None, NO_UPDATE_WEEKLY)]


def test_without_earlier_posts_all_weeks_count(spark):
    df = weeks_panel(spark, {"IN": [1, 1, 1, 1]})
    got = weekly_bulletins(df, posts(spark, "hello")).collect()
    assert len(got) == 4 and sum(r.text is None for r in got) == 2  # no three-week mean yet


def test_map_rows(spark):
    d = SUNDAY
    df = panel(spark, [("A", "OH", d, 3.0, 2.456), ("B", "OH", d + dt.timedelta(days=1), 9.0, None)])
    got = map_layer(df, "new_cases", d).first()
    assert got.popup == ("<strong>A, OH</strong><br /><strong>05/02/2021</strong><br /> Cases: 100<br /> Deaths: 3<br /> Case Rate: 12.34"
                         "<br /> Death Rate: 1<br /> New Cases: 3<br /> 7 Day Average: 2.46<br /> 7 Day Avg Rate: 0.13")
    assert got.position == pytest.approx((3 - 0.001) / (10 - 0.001))


def test_compared_series(spark):
    df = panel(spark, [("A", "OH", SUNDAY, 3.0, 1.0), ("B", "OH", SUNDAY, 4.0, 1.0)]).withColumn("NAME", F.concat("county_name", F.lit(", Ohio")))
    got = compare(df, ["A, Ohio"], "new_cases").collect()
    assert [(r.name, r.value, r.title, r.axis) for r in got] == [("A, Ohio", 3.0, "Number of New Cases (by day)", "Cases")]
    assert compare(df, ["A, Ohio"], "cases").first().title == "Total Number of Cases"


def test_dates_and_unallocated(spark):
    d = SUNDAY
    df = panel(spark, [("A", "OH", d, 1.0, 1.0), ("Statewide Unallocated", "OH", d, 2.0, 1.0), ("A", "OH", d - dt.timedelta(days=1), 5.0, 1.0)])
    assert at_latest(df).count() == 2 and at_date(df, "date", d - dt.timedelta(days=1)).count() == 1
    known, rest = split_unallocated(df)
    assert (known.count(), rest.count()) == (2, 1)
    table = unallocated_table(df, d, ["IN", "OH"]).first()
    assert (table.date, table.IN, table.OH) == (d, None, 100.0)


def test_stacked_shares_follow_one_category(spark):
    df = spark.createDataFrame([("a", "Yes", 1.0), ("a", "No", 3.0), ("b", "Yes", 1.0), ("b", "No", 0.0), ("c", "No", 2.0)], "k string, c string, v double")
    got = {(r.k, r.c): (r.prop, r.level) for r in stacked_shares(df, "k", "c", "v", "Yes").collect()}
    assert got == {("a", "Yes"): (0.25, 1), ("a", "No"): (0.75, 1), ("b", "Yes"): (1.0, 2), ("b", "No"): (0.0, 2), ("c", "No"): (1.0, None)}


def test_profile(spark):
    t = spark.createDataFrame([("Cook", "Illinois", "v1", 1.0), ("Cook", "Georgia", "v1", 2.0)], "County string, State string, variable string, estimate double")
    got = profile({"income": t, "race": t}, "Illinois", "Cook").orderBy("table").collect()
    assert [tuple(r) for r in got] == [("income", "v1", 1.0), ("race", "v1", 1.0)]


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2021, 5, 1)
    rows = [(start + dt.timedelta(hours=7 * i), "IN" if i % 3 else "OH", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, state string, new_cases double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r.week, r.state): r.state_new_cases for r in run_weekly(stream_weekly(stream), str(tmp_path / "out")).collect()}
    want = {}
    for ts, state, n in rows:
        week = ts.date() - dt.timedelta(days=(ts.date().weekday() + 1) % 7)
        want[week, state] = want.get((week, state), 0) + n
    assert got == want


def test_stream_without_data(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, state string, new_cases double").parquet(str(tmp_path / "in"))
    assert run_weekly(stream_weekly(stream), str(tmp_path / "out")).count() == 0
