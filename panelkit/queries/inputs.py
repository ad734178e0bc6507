"""Panels, wide files and census rows derived from the given tables, in Spark and in SQL.

* panel: nations as counties, regions as states, orders per day as new cases. A pending order takes one case
  back, which gives the negative corrections real series have.
* wide files: events per customer and day as cumulative text columns, one column per day.
* census rows: line quantities per customer and label ``Estimate!!Total!!sex!!age!!coverage`` with parent rows.
"""

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from panelkit.functions import per_capita
from panelkit.operators import daily_new, panel_rates, rolling_rate
from panelkit.plans.census import acs_tidy
from panelkit.plans.specs import TidySpec
from panelkit.queries.registry import Tables
from panelkit.sources import lookup

KEYS = ["county_name", "state"]
#: Rows of a given table to a partition where census rows are formed of them.
ROWS = 1 << 18


def parts(rows: DataFrame) -> int:
    """How many partitions take ``ROWS`` rows of a given table each; no fewer than there are cores.

    A partition sized by its shuffled bytes grows with the table, and small rows become many groups.
    """
    return max(-(-rows.count() // ROWS), rows.sparkSession.sparkContext.defaultParallelism)


# ---------------------------------------------------------------- panel

PLACES_SQL = """places AS (
  SELECT c_custkey, n_name AS county_name, r_name AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

P_SQL = PLACES_SQL + """,
people AS (
  SELECT county_name, state, CAST(count(*) * 1000 AS DOUBLE) AS population FROM places GROUP BY 1, 2),
daily AS (
  SELECT county_name, state, CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END) AS BIGINT) AS n,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS d
  FROM orders JOIN places ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (
  SELECT county_name, state, date, CAST(sum(n) OVER w AS DOUBLE) AS cases, CAST(sum(d) OVER w AS DOUBLE) AS deaths,
         population
  FROM daily LEFT JOIN people USING (county_name, state)
  WINDOW w AS (PARTITION BY county_name, state ORDER BY date))"""


def panel_sql(clamp: str = "after") -> str:
    """The panel with all derived columns, as table ``panel``."""
    raw = "cases - CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lag(cases) OVER w END"
    no_negative = "CASE WHEN raw < 0 THEN 0 ELSE raw END"
    base = no_negative if clamp == "before" else "raw"
    shown = no_negative if clamp == "after" else base
    return P_SQL + f""",
steps AS (
  SELECT *, {raw} AS raw, cases / population * 100000 AS case_rate, deaths / population * 100000 AS death_rate
  FROM p WINDOW w AS (PARTITION BY county_name, state ORDER BY date)),
means AS (
  SELECT *, CASE WHEN count(*) OVER w7 = 7 THEN avg({base}) OVER w7 END AS moving_7_day_avg, {shown} AS new_cases
  FROM steps
  WINDOW w7 AS (PARTITION BY county_name, state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
panel AS (
  SELECT county_name, state, date, cases, deaths, population, case_rate, death_rate,
         CAST(new_cases AS DOUBLE) AS new_cases, moving_7_day_avg,
         moving_7_day_avg / population * 100000 AS avg_7_day_rate, county_name || ', ' || state AS NAME
  FROM means)"""


def places(t: Tables) -> DataFrame:
    """Nation and region of every customer. Nations and regions are small; adaptive execution sees that."""
    geo = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", F.col("n_name").alias("county_name"), F.col("r_name").alias("state")))
    return (t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_acctbal", "c_mktsegment", "county_name", "state"))


def people(t: Tables) -> DataFrame:
    return places(t).groupBy(*KEYS).agg((F.count(F.lit(1)) * 1000).cast("double").alias("population"))


def daily_counts(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return (t.orders.join(places(t), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(*KEYS, F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.sum(F.when(status == "P", -1).otherwise(1)).alias("n"),
                 F.sum(F.when(status == "F", 1).otherwise(0)).alias("d")))


def p_panel(t: Tables) -> DataFrame:
    """Cumulative counts with population, one row per county and day."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    counts = daily_counts(t).select(*KEYS, "date", F.sum("n").over(w).cast("double").alias("cases"),
                                    F.sum("d").over(w).cast("double").alias("deaths"))
    return counts.join(people(t), KEYS, "left")


def full_panel(t: Tables, clamp: str = "after") -> DataFrame:
    """The panel with all derived columns."""
    return (rolling_rate(daily_new(panel_rates(p_panel(t)), KEYS, "date", "cases", clamp))
            .withColumn("NAME", F.concat("county_name", F.lit(", "), "state")))


# ---------------------------------------------------------------- wide files

E_SQL = """users AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Statewide Unallocated' ELSE c_name || ' County' END AS county_name,
         n_name AS state, greatest(floor(c_acctbal), 0) AS heads
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
e_people AS (SELECT county_name, state, CAST(sum(heads) AS DOUBLE) AS population FROM users GROUP BY 1, 2),
e_daily AS (
  SELECT county_name, state, CAST(ts AS DATE) AS date, count(*) AS n,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS d
  FROM events JOIN users ON user_id = c_custkey GROUP BY 1, 2, 3),
e_days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM e_daily),
e_grid AS (SELECT county_name, state, date FROM (SELECT DISTINCT county_name, state FROM e_daily), e_days),
e AS (
  SELECT county_name, state, date, CAST(sum(coalesce(n, 0) * 100) OVER w AS DOUBLE) AS cases,
         CAST(sum(coalesce(d, 0) * 100) OVER w AS DOUBLE) AS deaths
  FROM e_grid LEFT JOIN e_daily USING (county_name, state, date)
  WINDOW w AS (PARTITION BY county_name, state ORDER BY date))"""


def event_users(t: Tables) -> DataFrame:
    county = F.when(F.col("c_acctbal") < 0, F.lit("Statewide Unallocated")).otherwise(
        F.concat("c_name", F.lit(" County")))
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", county.alias("county_name"), F.col("n_name").alias("state"),
                    F.greatest(F.floor("c_acctbal"), F.lit(0)).alias("heads")))


def event_people(t: Tables) -> DataFrame:
    return event_users(t).groupBy(*KEYS).agg(F.sum("heads").cast("double").alias("population"))


def event_days(t: Tables) -> list[dt.date]:
    """The calendar of the wide files: two dates are read, the days between are counted out."""
    first, last = t.events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]


def event_counts(t: Tables, days: list[dt.date]) -> DataFrame:
    """Cumulative counts per county for every day, also days without events.

    Events shrink to one row per user and day before they are joined, so a very active user is no hot key.
    """
    per_user = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("d"))
    daily = (per_user.join(event_users(t), F.col("user_id") == F.col("c_custkey"))
             .groupBy(*KEYS, "date").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    grid = daily.select(*KEYS).distinct().withColumn(
        "date", F.explode(F.sequence(F.lit(days[0]), F.lit(days[-1]))))
    w = Window.partitionBy(*KEYS).orderBy("date")
    return (grid.join(daily, [*KEYS, "date"], "left")
            .select(*KEYS, "date", F.sum(F.coalesce("n", F.lit(0)) * 100).over(w).alias("cases"),
                    F.sum(F.coalesce("d", F.lit(0)) * 100).over(w).alias("deaths")))


def wide_file(counts: DataFrame, value: str, days: list[dt.date]) -> DataFrame:
    """One text column per day, with thousands commas, ids named as the publisher names them."""
    text = counts.select("county_name", "state", F.col("date").cast("string").alias("date"),
                         F.format_number(value, 0).alias(value))
    wide = text.groupBy(*KEYS).pivot("date", [d.isoformat() for d in days]).agg(F.first(value, ignorenulls=True))
    return wide.withColumnsRenamed({"county_name": "County Name", "state": "State"})


# ---------------------------------------------------------------- census rows

# Published labels.
SEXES = ["Male", "Female"]
AGES = ["Under 6 years", "6 to 18 years", "19 to 25 years", "26 to 34 years", "35 to 44 years"]
COVERAGE = ["With health insurance coverage", "No health insurance coverage"]

CODE_SQL = """'B27001_' || lpad(CAST(CASE WHEN s IS NULL THEN 1 WHEN a IS NULL THEN 2 + 16 * s
    WHEN c IS NULL THEN 3 + 16 * s + 3 * a ELSE 4 + 16 * s + 3 * a + c END AS VARCHAR), 3, '0')"""

L_SQL = f"""leaf AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS GEOID, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS s,
         CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS a, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS c,
         sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
parts AS (
  SELECT GEOID, s, a, c, sum(q) AS estimate FROM leaf
  GROUP BY GROUPING SETS ((GEOID), (GEOID, s), (GEOID, s, a), (GEOID, s, a, c))),
l AS (
  SELECT GEOID, {CODE_SQL} AS variable,
         'Estimate!!Total' || coalesce('!!' || ['Male', 'Female'][s + 1], '')
         || coalesce('!!' || ['Under 6 years', '6 to 18 years', '19 to 25 years', '26 to 34 years', '35 to 44 years'][a + 1], '')
         || coalesce('!!' || ['With health insurance coverage', 'No health insurance coverage'][c + 1], '') AS label,
         ['Male', 'Female'][s + 1] AS Sex,
         ['Under 6 years', '6 to 18 years', '19 to 25 years', '26 to 34 years', '35 to 44 years'][a + 1] AS Age,
         ['Yes', 'No'][c + 1] AS HI, CAST(estimate AS DOUBLE) AS estimate
  FROM parts)"""


def _code(s: int | None = None, a: int | None = None, c: int | None = None) -> int:
    if s is None:
        return 1
    if a is None:
        return 2 + 16 * s
    return 3 + 16 * s + 3 * a if c is None else 4 + 16 * s + 3 * a + c


def census_dictionary(t: Tables) -> DataFrame:
    """``(variable, label)`` of the derived census table."""
    rows = [(_code(), "Estimate!!Total")]
    for s, sex in enumerate(SEXES):
        rows.append((_code(s), f"Estimate!!Total!!{sex}"))
        for a, age in enumerate(AGES):
            rows.append((_code(s, a), f"Estimate!!Total!!{sex}!!{age}"))
            for c, cover in enumerate(COVERAGE):
                rows.append((_code(s, a, c), f"Estimate!!Total!!{sex}!!{age}!!{cover}"))
    return lookup(t.spark, [(f"B27001_{n:03d}", text) for n, text in rows], "variable string, label string")


def census_rows(t: Tables) -> DataFrame:
    """``(GEOID, variable, estimate)``: leaf sums first, the parents from the leaves.

    Lines are dealt to as many partitions as they need, by order and by leaf; the leaves move to their area, at most 20 to each, and
    all later groups of an area are formed there.
    """
    n = parts(t.lineitem)
    lines = t.lineitem.select("l_orderkey", "l_linestatus", "l_returnflag", "l_quantity").repartition(n, "l_orderkey")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").repartition(n, "o_orderkey")
    s, a, c = F.col("s"), F.col("a"), F.col("c")
    leaf = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("GEOID"),
                    F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("s"),
                    (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("a"),
                    F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("c"), "l_quantity")
            .repartition(n, "GEOID", "s", "a", "c").groupBy("GEOID", "s", "a", "c").agg(F.sum("l_quantity").alias("q"))
            .repartition(n, "GEOID"))
    none = F.lit(None).cast("int")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), (s if i > 0 else none).alias("s"), (a if i > 1 else none).alias("a"),
                                (c if i > 2 else none).alias("c")) for i in range(4)])
    # the level tells a missing value from one summed over
    sums = leaf.select("GEOID", "q", F.inline(levels)).groupBy("GEOID", "level", "s", "a", "c").agg(F.sum("q").alias("estimate"))
    code = (F.when(s.isNull(), F.lit(1)).when(a.isNull(), 2 + 16 * s).when(c.isNull(), 3 + 16 * s + 3 * a)
            .otherwise(4 + 16 * s + 3 * a + c))
    return sums.select("GEOID", F.concat(F.lit("B27001_"), F.lpad(code.cast("string"), 3, "0")).alias("variable"), "estimate")


def labelled(t: Tables) -> DataFrame:
    """Census rows with their label."""
    return census_rows(t).join(census_dictionary(t), "variable", "left")


INSURANCE = TidySpec("B27001", depth_from=4, into=("Sex", "Age", "HI"),
                     flags={"HI": ("No health insurance coverage", "No", "Yes")})


def leaves(t: Tables) -> DataFrame:
    """Census leaf rows with their three dimensions."""
    tidy = acs_tidy(census_rows(t), census_dictionary(t), INSURANCE)
    return tidy.select("GEOID", "variable", "Sex", "Age", "HI", "estimate")


ZIPS_SQL = """zips AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS zip, CAST(count(o_orderkey) AS DOUBLE) AS Cases,
         CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) AS Deaths,
         CAST(greatest(floor(max(c_acctbal)), 0) AS DOUBLE) AS Population
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
covid AS (
  SELECT *, Cases / nullif(Population, 0) * 100000 AS case_rate, Deaths / nullif(Population, 0) * 100000 AS death_rate
  FROM zips)"""


def zip_cases(t: Tables) -> DataFrame:
    """Orders per customer as cases per ZIP code, with rates. Orders shrink to one row per customer first."""
    per = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("f"))
    zips = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("zip"),
        F.coalesce("n", F.lit(0.0)).alias("Cases"), F.coalesce("f", F.lit(0.0)).alias("Deaths"),
        F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("double").alias("Population"))
    return zips.withColumns({"case_rate": per_capita("Cases", "Population"),
                             "death_rate": per_capita("Deaths", "Population")})
