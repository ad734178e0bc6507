"""Panels, rates and the composite jobs."""

from pyspark.sql import DataFrame, functions as F

from panelkit.operators import (
    at_date, daily_new, panel_rates, positivity, rolling_mean_strict, rolling_rate, snapshot_rates,
)
from panelkit.plans import (
    acs_tidy, build_panel, build_snapshot, city_report, feature_master, refresh_panel,
)
from panelkit.plans.specs import CategorySpec, FeatureSpec, TidySpec
from panelkit.queries import inputs as I
from panelkit.queries.registry import query, rounded, Tables
from panelkit.session import scratch_path

PANEL_COLUMNS = ("county_name, state, date, cases, deaths, population, round(case_rate, 6) AS case_rate, "
                 "round(death_rate, 6) AS death_rate, new_cases, round(moving_7_day_avg, 6) AS moving_7_day_avg, "
                 "round(avg_7_day_rate, 6) AS avg_7_day_rate")


@query("daily_panel", f"WITH {I.panel_sql()} SELECT {PANEL_COLUMNS} FROM panel")
def daily_panel(t: Tables) -> DataFrame:
    """Rates, changes and rolling means; the mean is taken before negative changes become 0."""
    return rounded(I.full_panel(t).drop("NAME"))


@query("daily_panel_clamp_before", f"""
WITH {I.panel_sql("before")} SELECT county_name, state, date, new_cases, round(moving_7_day_avg, 6) AS moving_7_day_avg FROM panel""")
def daily_panel_clamp_before(t: Tables) -> DataFrame:
    return rounded(daily_new(I.p_panel(t), I.KEYS, "date", "cases", "before")
                   .select(*I.KEYS, "date", "new_cases", "moving_7_day_avg"))


@query("daily_panel_unclamped", f"""
WITH {I.panel_sql("none")} SELECT county_name, state, date, new_cases, round(moving_7_day_avg, 6) AS moving_7_day_avg FROM panel""")
def daily_panel_unclamped(t: Tables) -> DataFrame:
    return rounded(daily_new(I.p_panel(t), I.KEYS, "date", "cases", "none")
                   .select(*I.KEYS, "date", "new_cases", "moving_7_day_avg"))


@query("user_rolling_mean", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT user_id, day, round(CASE WHEN count(*) OVER w = 7 THEN avg(total) OVER w END, 6) AS mean
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def user_rolling_mean(t: Tables) -> DataFrame:
    """Raw events become one row per user and day before any window sees them."""
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return rounded(days.select("user_id", "day", rolling_mean_strict("total", ["user_id"], "day", 7).alias("mean")))


@query("cumulative_rates", f"""
WITH {I.P_SQL}
SELECT county_name, state, date, round(cases / population * 100000, 6) AS case_rate,
       round(deaths / population * 100000, 6) AS death_rate FROM p""")
def cumulative_rates(t: Tables) -> DataFrame:
    return rounded(panel_rates(I.p_panel(t)).select(*I.KEYS, "date", "case_rate", "death_rate"))


@query("weekly_sum_rate", f"""
WITH {I.panel_sql()}
SELECT county_name, state, date, round(moving_7_day_avg * 7 / population * 100000, 6) AS new_eqn FROM panel""")
def weekly_sum_rate(t: Tables) -> DataFrame:
    rows = rolling_rate(daily_new(I.p_panel(t), I.KEYS, "date", "cases"), days=7, name="new_eqn")
    return rounded(rows.select(*I.KEYS, "date", "new_eqn"))


@query("zip_snapshot_rates", f"""
WITH {I.ZIPS_SQL}
SELECT zip, Cases, Deaths, Population, round_even(Deaths / nullif(Cases, 0) * 100, 3) AS case_fatality,
       round_even(Deaths / nullif(Population, 0) * 100000, 3) AS death_rate,
       round_even(Cases / nullif(Population, 0) * 100000, 3) AS case_rate
FROM zips""")
def zip_snapshot_rates(t: Tables) -> DataFrame:
    return snapshot_rates(I.zip_cases(t).select("zip", "Cases", "Deaths", "Population"))


@query("zip_rate_per_head", f"""
WITH {I.ZIPS_SQL} SELECT zip, round(Cases / nullif(Population, 0), 9) AS case_rate FROM zips""")
def zip_rate_per_head(t: Tables) -> DataFrame:
    rows = snapshot_rates(I.zip_cases(t).select("zip", "Cases", "Deaths", "Population"), per=1, digits=None)
    return rounded(rows.select("zip", "case_rate"), 9)


@query("positivity_by_part", """
SELECT l_partkey, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) AS Cases, CAST(count(*) AS DOUBLE) AS Tested,
       round(count(CASE WHEN l_returnflag = 'R' THEN 1 END) / count(*), 9) AS pos_rate
FROM lineitem GROUP BY 1""")
def positivity_by_part(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("Cases"), F.count(F.lit(1)).cast("double").alias("Tested"))
    return rounded(positivity(counts), 9)


# ---------------------------------------------------------------- from wide files

BUILT_SQL = I.E_SQL + """,
steps AS (
  SELECT e.*, population, cases - coalesce(lag(cases) OVER w, 0) AS new_cases
  FROM e LEFT JOIN e_people USING (county_name, state)
  WHERE county_name NOT LIKE '%Statewide Unallocated%' WINDOW w AS (PARTITION BY county_name, state ORDER BY date)),
built AS (
  SELECT county_name, state, date, cases, deaths, population, cases / nullif(population, 0) * 100000 AS case_rate,
         deaths / nullif(population, 0) * 100000 AS death_rate, new_cases,
         CASE WHEN count(*) OVER w7 = 7 THEN avg(new_cases) OVER w7 END AS moving_7_day_avg,
         CASE WHEN count(*) OVER w7 = 7 THEN avg(new_cases) OVER w7 END / nullif(population, 0) * 100000 AS avg_7_day_rate,
         county_name || ', ' || replace(state, 'NATION_', 'Nation ') AS NAME, county_name || ', ' || state AS name_short
  FROM steps WINDOW w7 AS (PARTITION BY county_name, state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


def _wide_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Wide cases and deaths, population, and the state names, shaped as the publisher's files."""
    days = I.event_days(t)
    counts = I.event_counts(t, days)
    pop = I.event_people(t).withColumnsRenamed({"county_name": "County Name", "state": "State"})
    names = t.nation.select(F.replace("n_name", F.lit("NATION_"), F.lit("Nation ")).alias("State"), F.col("n_name").alias("Abb"))
    return I.wide_file(counts, "cases", days), I.wide_file(counts, "deaths", days), pop, names


@query("built_panel", f"WITH {BUILT_SQL} SELECT {PANEL_COLUMNS}, NAME, name_short FROM built")
def built_panel(t: Tables) -> DataFrame:
    """Wide text files to the finished county panel."""
    cases, deaths, pop, names = _wide_inputs(t)
    return rounded(build_panel(cases, deaths, pop, states=None, names=names))


@query("refreshed_panel", f"WITH {BUILT_SQL} SELECT {PANEL_COLUMNS}, NAME, name_short FROM built")
def refreshed_panel(t: Tables) -> DataFrame:
    """The panel published from files without the last days and with other counts in some counties, then brought up to date."""
    cases, deaths, pop, names = _wide_inputs(t)
    path = scratch_path(t.spark, "panel")
    days = [c for c in cases.columns if c not in ("County Name", "State")]
    wrong = F.col("State") == "NATION_3"
    early = cases.drop(*days[-9:]).withColumn(days[4], F.when(wrong, F.lit("7")).otherwise(F.col(f"`{days[4]}`")))
    refresh_panel(early, deaths.drop(*days[-9:]), pop.filter("State != 'NATION_5'"), path, states=None, names=names)
    return rounded(refresh_panel(cases, deaths, pop, path, states=None, names=names))


@query("latest_weekly_rate", f"""
WITH {BUILT_SQL} SELECT county_name, state, date, cases, new_cases, round(avg_7_day_rate, 6) AS avg_7_day_rate FROM built
WHERE date = (SELECT max(date) FROM built)""")
def latest_weekly_rate(t: Tables) -> DataFrame:
    """The flagship: newest rolling rate per county, from the wide files."""
    cases, deaths, pop, names = _wide_inputs(t)
    newest = cases.columns[-1]  # the last column of a wide file is its newest date
    panel = at_date(build_panel(cases, deaths, pop, states=None, names=names), "date", newest)
    return rounded(panel.select("county_name", "state", "date", "cases", "new_cases", "avg_7_day_rate"))


@query("built_snapshot", f"""
WITH {I.E_SQL}
SELECT county_name || ', ' || replace(state, 'NATION_', 'Nation ') AS NAME, county_name AS County,
       replace(state, 'NATION_', 'Nation ') AS State, state AS State_abb, cases AS Cases, deaths AS Deaths, population AS Population,
       round_even(deaths / nullif(cases, 0) * 100, 3) AS case_fatality,
       round_even(deaths / nullif(population, 0) * 100000, 3) AS death_rate,
       round_even(cases / nullif(population, 0) * 100000, 3) AS case_rate
FROM e LEFT JOIN e_people USING (county_name, state) WHERE date = (SELECT max(date) FROM e)""")
def built_snapshot(t: Tables) -> DataFrame:
    cases, deaths, pop, names = _wide_inputs(t)
    return build_snapshot(cases, deaths, pop, states=None, names=names)


# ---------------------------------------------------------------- census composites


@query("tidy_census_table", f"""
WITH {I.L_SQL}
SELECT GEOID, variable, Sex, Age, HI, CASE Sex WHEN 'Male' THEN 1 ELSE 2 END AS Sex_ord,
       list_position(['Under 6 years', '6 to 18 years', '19 to 25 years', '26 to 34 years', '35 to 44 years'], Age) AS Age_ord,
       CASE HI WHEN 'Yes' THEN 1 ELSE 2 END AS HI_ord, estimate
FROM l WHERE HI IS NOT NULL""")
def tidy_census_table(t: Tables) -> DataFrame:
    return acs_tidy(I.census_rows(t), I.census_dictionary(t), I.INSURANCE)


BLOCKS = {
    "insurance": FeatureSpec(I.INSURANCE, ("Sex", "Age", "HI"), {"B27001_026": {
        "prop_Age": "prop_19_to_25", "prop_HI": "prop_with_HI", "prop_Sex_Age": "prop_female_19_to_25",
        "prop_Sex_HI": "prop_female_with_HI", "prop_Sex_Age_HI": "prop_female_19_to_25_with_HI"}}, total="zip_pop"),
    "minors": FeatureSpec(
        TidySpec("B27001", depth_from=4, into=("Sex", "Band"),
                 groups={"Band": ({"0-18": ["Under 6 years", "6 to 18 years"]}, "19+")}),
        ("Sex", "Band"), {"B27001_004": {"prop_Band": "prop_minor", "prop_Sex_Band": "prop_male_minor"},
                          "B27001_010": {"prop_Band": "prop_adult"}}),
    "uninsured_male": FeatureSpec(
        TidySpec("B27001", depth_from=4, reject=("Female",), remove=("Estimate!!Total!!Male!!",), into=("Age", "HI"),
                 contains={"HI": ((("No health", "No"),), "Yes")}),
        ("Age", "HI"), {"B27001_005": {"prop_HI": "prop_male_no_HI"}}, total="zip_pop_male"),
}


@query("feature_master", f"""
WITH {I.L_SQL}, c AS (SELECT * FROM l WHERE HI IS NOT NULL),
a AS (SELECT GEOID, sum(estimate) AS zip_pop, sum(CASE WHEN Age = '19 to 25 years' THEN estimate END) AS x1,
  sum(CASE WHEN HI = 'Yes' THEN estimate END) AS x2, sum(CASE WHEN Age = '19 to 25 years' AND Sex = 'Female' THEN estimate END) AS x3,
  sum(CASE WHEN HI = 'Yes' AND Sex = 'Female' THEN estimate END) AS x4,
  sum(CASE WHEN Age = '19 to 25 years' AND HI = 'Yes' AND Sex = 'Female' THEN estimate END) AS x5,
  sum(CASE WHEN Age IN ('Under 6 years', '6 to 18 years') THEN estimate END) AS x6,
  sum(CASE WHEN Age IN ('Under 6 years', '6 to 18 years') AND Sex = 'Male' THEN estimate END) AS x7,
  sum(CASE WHEN Age NOT IN ('Under 6 years', '6 to 18 years') THEN estimate END) AS x8,
  sum(CASE WHEN Sex = 'Male' THEN estimate END) AS zip_pop_male,
  sum(CASE WHEN Sex = 'Male' AND HI = 'No' THEN estimate END) AS x9,
  bool_or(Age = '19 to 25 years' AND HI = 'Yes' AND Sex = 'Female') AS k1,
  bool_or(variable = 'B27001_004') AS k2, bool_or(variable = 'B27001_010') AS k3,
  bool_or(Age = 'Under 6 years' AND HI = 'No' AND Sex = 'Male') AS k4 FROM c GROUP BY 1)
SELECT GEOID, CASE WHEN k1 THEN zip_pop END AS zip_pop, CASE WHEN k4 THEN zip_pop_male END AS zip_pop_male,
  round(CASE WHEN k1 THEN x1 / zip_pop END, 6) AS prop_19_to_25, round(CASE WHEN k1 THEN x2 / zip_pop END, 6) AS prop_with_HI,
  round(CASE WHEN k1 THEN x3 / zip_pop END, 6) AS prop_female_19_to_25,
  round(CASE WHEN k1 THEN x4 / zip_pop END, 6) AS prop_female_with_HI,
  round(CASE WHEN k1 THEN x5 / zip_pop END, 6) AS prop_female_19_to_25_with_HI,
  round(CASE WHEN k2 THEN x6 / zip_pop END, 6) AS prop_minor, round(CASE WHEN k2 THEN x7 / zip_pop END, 6) AS prop_male_minor,
  round(CASE WHEN k3 THEN x8 / zip_pop END, 6) AS prop_adult, round(CASE WHEN k4 THEN x9 / zip_pop_male END, 6) AS prop_male_no_HI
FROM a WHERE k1 OR k2 OR k3 OR k4""")
def feature_master_query(t: Tables) -> DataFrame:
    return rounded(feature_master(I.census_rows(t), I.census_dictionary(t), specs=BLOCKS))


STUDIES = {
    "minors": CategorySpec("B27001", "prop_minor", ["Under 6 years", "6 to 18 years"], tidy=I.INSURANCE, label="Age"),
    "insured": CategorySpec("B27001", "prop_insured", ["Yes"], tidy=I.INSURANCE, label="HI"),
    "women": CategorySpec("B27001", "prop_women", "^Female$", codes=["B27001_002", "B27001_018"]),
}


def _study_sql(name: str, hit: str, where: str) -> str:
    return f"""SELECT '{name}' AS measure, corr(x, case_rate) AS r, count(CASE WHEN x IS NOT NULL AND case_rate IS NOT NULL THEN 1 END) AS n
  FROM (SELECT GEOID, sum(CASE WHEN {hit} THEN estimate END) / sum(estimate) AS x FROM l WHERE {where} GROUP BY 1
        HAVING count(CASE WHEN {hit} THEN 1 END) > 0) LEFT JOIN covid ON GEOID = zip WHERE case_rate < 5000"""


@query("city_report", f"""
WITH {I.L_SQL}, {I.ZIPS_SQL}, s AS (
  {_study_sql("prop_minor", "Age IN ('Under 6 years', '6 to 18 years')", "HI IS NOT NULL")}
  UNION ALL {_study_sql("prop_insured", "HI = 'Yes'", "HI IS NOT NULL")}
  UNION ALL {_study_sql("prop_women", "Sex = 'Female'", "variable IN ('B27001_002', 'B27001_018')")})
SELECT measure, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t,
       round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high
FROM s""")
def city_report_query(t: Tables) -> DataFrame:
    """Correlation tests of several demographics against the case rate, without extreme ZIP codes."""
    tests = city_report(I.zip_cases(t), I.census_rows(t), I.census_dictionary(t), None, STUDIES, above=5000)
    return rounded(tests.select("measure", "r", "n", "t", "low", "high"))
