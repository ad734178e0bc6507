"""Report and bulletin tables, and the weekly stream."""

from pyspark.sql import DataFrame, functions as F

from panelkit.plans import (
    acs_tidy, compare, daily_bulletin, last_published_week, map_layer, profile, publish_gate, split_place, stacked_shares,
    unallocated_table, weekly_bulletins,
)
from panelkit.plans.reports import NO_UPDATE_DAILY
from panelkit.plans.specs import METRICS
from panelkit.queries import inputs as I
from panelkit.queries.registry import query, rounded, Tables
from panelkit.queries.tables import REGIONS
from panelkit.streaming import run_weekly, stream_weekly


def _text_sql(column: str, digits: int) -> str:
    shown = f"CAST(CAST(round_even({column}, {digits}) AS DECIMAL(30,{digits})) AS VARCHAR)"
    return f"regexp_replace({shown}, '\\.?0+$', '')" if digits else shown


POPUP_SQL = ("'<strong>' || county_name || ', ' || state || '</strong><br /><strong>' || strftime(date, '%m/%d/%Y') || '</strong>'"
             + "".join(f" || '<br /> {name}: ' || {_text_sql(c, d)}" for name, c, d in (
                 ("Cases", "cases", 0), ("Deaths", "deaths", 0), ("Case Rate", "case_rate", 2), ("Death Rate", "death_rate", 2),
                 ("New Cases", "new_cases", 0), ("7 Day Average", "moving_7_day_avg", 2), ("7 Day Avg Rate", "avg_7_day_rate", 2))))


@query("map_layer", f"""
WITH {I.panel_sql()}
SELECT county_name, state, date, round(case_rate, 6) AS value, {POPUP_SQL} AS popup,
       round((case_rate - 0.001) / ((SELECT max(case_rate) FROM panel) + 1 - 0.001), 6) AS position
FROM panel WHERE date = DATE '2001-07-01'""")
def map_layer_query(t: Tables) -> DataFrame:
    return rounded(map_layer(I.full_panel(t), "case_rate", "2001-07-01"))


TITLES = {m: (a, b) for m, a, b in METRICS}


COMPARED = ["NATION_3, EUROPE", "NATION_11, AMERICA"]


@query("compared_counties", f"""
WITH {I.panel_sql()}
SELECT NAME AS name, date, round(avg_7_day_rate, 6) AS value, 'COVID in {COMPARED[0]} and {COMPARED[1]}' AS heading,
       '{TITLES["avg_7_day_rate"][0]}' AS title, '{TITLES["avg_7_day_rate"][1]}' AS axis
FROM panel WHERE NAME IN ('{COMPARED[0]}', '{COMPARED[1]}')""")
def compared_counties(t: Tables) -> DataFrame:
    return rounded(compare(I.full_panel(t), COMPARED, "avg_7_day_rate"))


def _reported_sql(column: str) -> str:
    return f"CASE WHEN {column} = 0 THEN 'Not Reported' ELSE {_text_sql(column, 0)} END"


DAILY_SQL = f"""{I.panel_sql()},
states AS (SELECT date, state, sum(new_cases) AS total, round_even(sum(moving_7_day_avg), 0) AS mean FROM panel
           WHERE date = (SELECT max(date) FROM panel) GROUP BY 1, 2),
bulletin AS (SELECT date, 'Daily Newly Reported Cases by State for ' || strftime(date, '%B %d, %Y')
  || ' (7-day Moving Average in Parentheses)' || chr(10) || chr(10)
  || string_agg(state || ': ' || {_reported_sql("total")} || ' (' || {_text_sql("mean", 0)} || ')', chr(10) ORDER BY state) AS text
  FROM states GROUP BY 1)"""


@query("daily_bulletin", f"WITH {DAILY_SQL} SELECT date, text FROM bulletin")
def daily_bulletin_query(t: Tables) -> DataFrame:
    return daily_bulletin(I.full_panel(t))


@query("publish_gate", f"""
WITH {DAILY_SQL}
SELECT date, date = DATE '2001-08-02' - 1 AS fresh, CASE WHEN date = DATE '2001-08-02' - 1 THEN text ELSE '{NO_UPDATE_DAILY}' END AS text
FROM bulletin""")
def publish_gate_query(t: Tables) -> DataFrame:
    return publish_gate(I.full_panel(t), "2001-08-02")


def earlier_posts(t: Tables) -> DataFrame:
    """One post per order day: bulletins up to March 2001, replies after that."""
    day = F.to_date("o_orderdate")
    start = F.when(day <= F.lit("2001-03-31").cast("date"), F.lit("Daily Newly Reported Cases by State for ")).otherwise(
        F.lit("Reply: cases by State for "))
    return t.orders.select(F.concat(start, F.date_format(day, "MMMM dd, yyyy"), F.lit(" (7-day")).alias("text")).distinct()


@query("last_published_week", """
SELECT CAST(max(d) - CAST(dayofweek(max(d)) AS INT) AS DATE) AS mark
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE d <= DATE '2001-03-31'""")
def last_published_week_query(t: Tables) -> DataFrame:
    return last_published_week(earlier_posts(t))


@query("weekly_bulletins", f"""
WITH {I.panel_sql("before")},
w AS (SELECT state, CAST(date - CAST(dayofweek(date) AS INT) AS DATE) AS week, sum(new_cases) AS total FROM panel GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN count(*) OVER x = 3 THEN avg(total) OVER x END AS mean FROM w
      WINDOW x AS (PARTITION BY state ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
mark AS (SELECT CAST(max(d) - CAST(dayofweek(max(d)) AS INT) AS DATE) AS mark
         FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE d <= DATE '2001-03-31'),
fresh AS (SELECT m.* FROM m, mark WHERE week > mark),
weeks AS (SELECT week, bool_and(total = 0) AS empty FROM fresh GROUP BY 1),
stop AS (SELECT min(week) AS stop FROM weeks WHERE empty AND week > (SELECT min(week) FROM weeks))
SELECT week, 'New Weekly Reported Cases by State for ' || strftime(week, '%B %d, %Y') || ' (3-week Moving Average in Parentheses)'
  || chr(10) || chr(10) || string_agg(CASE WHEN total = 0 AND mean = 0 THEN state || ': No longer reporting'
     ELSE state || ': ' || {_reported_sql("total")} || ' (' || {_text_sql("round_even(mean, 0)", 0)} || ')' END, chr(10) ORDER BY state) AS text
FROM fresh, stop WHERE stop IS NULL OR week < stop GROUP BY week""")
def weekly_bulletins_query(t: Tables) -> DataFrame:
    return weekly_bulletins(I.full_panel(t, "before"), earlier_posts(t))


NATIONS = [f"NATION_{i}" for i in range(25)]


@query("unallocated_table", f"""
WITH {I.E_SQL}
SELECT date, """ + ", ".join(f"max(cases) FILTER (WHERE state = '{s}') AS \"{s}\"" for s in NATIONS) + """
FROM e WHERE county_name LIKE '%Statewide Unallocated%' AND date = DATE '2024-01-20' GROUP BY 1""")
def unallocated_table_query(t: Tables) -> DataFrame:
    counts = I.event_counts(t, I.event_days(t)).withColumn("cases", F.col("cases").cast("double"))
    return unallocated_table(counts, "2024-01-20", NATIONS)


@query("stacked_shares", """
WITH c AS (SELECT c_nationkey, o_orderpriority, sum(o_totalprice) AS count
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT *, sum(count) OVER (PARTITION BY c_nationkey) AS pop, count / sum(count) OVER (PARTITION BY c_nationkey) AS prop FROM c),
o AS (SELECT c_nationkey, row_number() OVER (ORDER BY prop, c_nationkey) AS level FROM s WHERE o_orderpriority = '1-URGENT')
SELECT c_nationkey, o_orderpriority, round(count, 2) AS count, round(prop, 6) AS prop, level FROM s LEFT JOIN o USING (c_nationkey)""")
def stacked_shares_query(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = stacked_shares(rows, "c_nationkey", "o_orderpriority", "o_totalprice", "1-URGENT").drop("pop")
    return rounded(rounded(out, 2, "count"))


@query("county_profile", f"""
WITH {I.L_SQL}, named AS (
  SELECT variable, HI, sum(estimate) AS estimate FROM l JOIN customer ON CAST(GEOID AS BIGINT) = c_custkey
  WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' GROUP BY 1, 2)
SELECT 'all' AS "table", variable, estimate FROM named
UNION ALL SELECT 'insurance', variable, estimate FROM named WHERE HI IS NOT NULL""")
def county_profile(t: Tables) -> DataFrame:
    """Segments as counties, nations as states: ``BUILDING County, NATION_7``."""
    geo = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
           .select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("GEOID"),
                   F.concat("c_mktsegment", F.lit(" County, "), "n_name").alias("NAME")))
    rows = I.census_rows(t).join(geo, "GEOID").groupBy("NAME", "variable").agg(F.sum("estimate").alias("estimate"))
    tidy = acs_tidy(rows, I.census_dictionary(t), I.INSURANCE)
    return profile({"all": split_place(rows), "insurance": split_place(tidy)}, "NATION_7", "BUILDING")


@query("streamed_weeks", """
SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS DATE) AS week, event_type AS state, round(sum(value), 4) AS state_new_cases
FROM events GROUP BY 1, 2""")
def streamed_weeks(t: Tables) -> DataFrame:
    """Events read as a file stream and summed per Sunday week."""
    stream = (t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
              .select("ts", F.col("event_type").alias("state"), F.col("value").alias("new_cases")))
    return rounded(run_weekly(stream_weekly(stream)), 4)
