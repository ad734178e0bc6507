"""Aggregates, shares, orders and scalar functions."""

from pyspark.sql import DataFrame, functions as F

from panelkit.functions import (
    band, extract_or_null, half_even, long_date, parse_us_date, range_midpoint, short_date, signif, sum_strict,
    sunday_week, title_name,
)
from panelkit.operators import (
    box_outliers, category_share, date_span, five_number, join_lines, mean_above, ordered_levels, rolling_mean_strict,
    share, subset_shares, subset_totals, top_k, two_level_share, with_total,
)
from panelkit.plans.specs import METRICS
from panelkit.queries import inputs as I
from panelkit.queries.registry import query, rounded, Tables
from panelkit.sources import lookup

# ---------------------------------------------------------------- aggregates


@query("revenue_by_nation", """
SELECT n_name, CASE WHEN count(*) = count(CASE WHEN o_orderstatus <> 'X' THEN o_totalprice END)
       THEN round(sum(o_totalprice), 2) END AS revenue,
       CASE WHEN count(*) = count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) THEN CAST(1 AS DOUBLE) END AS strict_gap
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def revenue_by_nation(t: Tables) -> DataFrame:
    """Sums that turn NULL as soon as one value is missing."""
    gap = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    sums = (t.orders.withColumn("gap", gap).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey").agg(sum_strict("o_totalprice").alias("revenue"), sum_strict("gap").alias("g")))
    return rounded(sums.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
                   .select("n_name", "revenue", F.when(F.col("g").isNotNull(), F.lit(1.0)).alias("strict_gap")), 2)


@query("state_by_date", f"""
WITH {I.panel_sql()}
SELECT state, date, sum(new_cases) AS new_cases, sum(cases) AS cases FROM panel GROUP BY 1, 2""")
def state_by_date(t: Tables) -> DataFrame:
    return I.full_panel(t).groupBy("state", "date").agg(
        sum_strict("new_cases").alias("new_cases"), sum_strict("cases").alias("cases"))


@query("state_by_week", f"""
WITH {I.panel_sql()}
SELECT state, CAST(date - CAST(dayofweek(date) AS INT) AS DATE) AS week, sum(new_cases) AS new_cases
FROM panel GROUP BY 1, 2""")
def state_by_week(t: Tables) -> DataFrame:
    return I.full_panel(t).groupBy("state", sunday_week("date").alias("week")).agg(sum_strict("new_cases").alias("new_cases"))


@query("state_rolling_sum", f"""
WITH {I.panel_sql()}
SELECT state, date, CASE WHEN count(*) = count(moving_7_day_avg) THEN round_even(round(sum(moving_7_day_avg), 6), 0) END AS mean
FROM panel GROUP BY 1, 2""")
def state_rolling_sum(t: Tables) -> DataFrame:
    return I.full_panel(t).groupBy("state", "date").agg(
        half_even(F.round(sum_strict("moving_7_day_avg"), 6)).alias("mean"))


@query("panel_dates", f"""
WITH {I.P_SQL} SELECT min(date) AS first_date, max(date) AS last_date FROM p""")
def panel_dates(t: Tables) -> DataFrame:
    return date_span(I.p_panel(t))


@query("distinct_orders", """
SELECT DISTINCT o_custkey, o_orderpriority FROM orders""")
def distinct_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderpriority").dropDuplicates()


@query("price_summary", """
SELECT min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
       round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS max,
       CAST(count(*) - count(o_totalprice) AS BIGINT) AS missing
FROM orders""")
def price_summary(t: Tables) -> DataFrame:
    return rounded(rounded(five_number(t.orders, "o_totalprice"), 4, "mean"))


@query("price_summary_by_priority", """
SELECT o_orderpriority, round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS median,
       round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS max, 0 AS missing
FROM orders GROUP BY 1""")
def price_summary_by_priority(t: Tables) -> DataFrame:
    """The same for every group at once."""
    return rounded(five_number(t.orders, "o_totalprice", ["o_orderpriority"]), 4)


@query("price_outliers", """
WITH total AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY 1),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM total),
h AS (SELECT floor((max(n) + 3) / 2) / 2 AS depth, max(n) AS n FROM r),
e AS (SELECT (max(x) FILTER (WHERE i = floor(depth)) + max(x) FILTER (WHERE i = ceil(depth))) / 2 AS lo,
             (max(x) FILTER (WHERE i = floor(h.n + 1 - depth)) + max(x) FILTER (WHERE i = ceil(h.n + 1 - depth))) / 2 AS hi
      FROM r, h)
SELECT o_custkey, round(x, 2) AS x FROM total, e WHERE x < lo - 1.5 * (hi - lo) OR x > hi + 1.5 * (hi - lo)""")
def price_outliers(t: Tables) -> DataFrame:
    return rounded(box_outliers(t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x")), "x"), 2)


@query("panel_predicates", f"""
WITH {I.panel_sql()}
SELECT state, count(*) AS n, bool_and(cases > 0) AS all_positive, bool_or(new_cases = 0) AS any_zero FROM panel GROUP BY 1""")
def panel_predicates(t: Tables) -> DataFrame:
    return I.full_panel(t).groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("cases") > 0).alias("all_positive"),
        F.bool_or(F.col("new_cases") == 0).alias("any_zero"))


@query("joined_lines", f"""
WITH {I.P_SQL}, s AS (SELECT date, state, sum(n) AS n FROM daily GROUP BY 1, 2)
SELECT date, string_agg(state || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY state) AS text FROM s GROUP BY 1""")
def joined_lines(t: Tables) -> DataFrame:
    sums = I.daily_counts(t).groupBy("date", "state").agg(F.sum("n").alias("n"))
    return join_lines(sums, ["date"], F.concat("state", F.lit(": "), F.col("n").cast("string")), "state")


# ---------------------------------------------------------------- shares

LEAF = "Sex IS NOT NULL AND Age IS NOT NULL AND HI IS NOT NULL"
DIMS = ["Sex", "Age", "HI"]


SUBSETS = [("Sex",), ("Age",), ("HI",), ("Sex", "Age"), ("Sex", "HI"), ("Age", "HI"), ("Sex", "Age", "HI")]


@query("label_shares", f"""
WITH {I.L_SQL}
SELECT GEOID, variable, estimate, sum(estimate) OVER (PARTITION BY GEOID) AS n,
       round(estimate / sum(estimate) OVER (PARTITION BY GEOID), 6) AS prop
FROM l WHERE {LEAF}""")
def label_shares(t: Tables) -> DataFrame:
    return rounded(share(I.leaves(t).select("GEOID", "variable", "estimate"), "GEOID", "estimate"))


@query("line_shares_of_part", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_partkey), 8) AS prop
FROM lineitem""")
def line_shares_of_part(t: Tables) -> DataFrame:
    """Shares on raw rows, where one part may hold a large part of the table."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rounded(share(rows, "l_partkey", "l_quantity"), 8).drop("n", "l_quantity")


@query("detail_with_total", """
SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total FROM orders""")
def detail_with_total(t: Tables) -> DataFrame:
    rows = with_total(t.orders, "o_custkey", "o_totalprice", "customer_total")
    return rounded(rows.select("o_orderkey", "o_custkey", "customer_total"), 2)


@query("subset_shares", f"""
WITH {I.L_SQL}
SELECT GEOID, variable, sum(estimate) OVER (PARTITION BY GEOID) AS zip_pop, """ + ", ".join(
    f"round(sum(estimate) OVER (PARTITION BY GEOID, {', '.join(s)}) / sum(estimate) OVER (PARTITION BY GEOID), 6) AS prop_{'_'.join(s)}"
    for s in SUBSETS) + f" FROM l WHERE {LEAF}")
def subset_shares_query(t: Tables) -> DataFrame:
    rows = subset_shares(I.leaves(t), "GEOID", DIMS, "estimate")
    return rounded(rows.select("GEOID", "variable", "zip_pop", *["prop_" + "_".join(s) for s in SUBSETS]))


@query("subset_lattice", f"""
WITH {I.L_SQL}, cells AS (SELECT * FROM l WHERE {LEAF}),
cubed AS (SELECT GEOID, Sex, Age, HI, sum(estimate) AS total, concat_ws('+',
    CASE WHEN grouping(Sex) = 0 THEN 'Sex' END, CASE WHEN grouping(Age) = 0 THEN 'Age' END,
    CASE WHEN grouping(HI) = 0 THEN 'HI' END) AS subset
  FROM cells GROUP BY GEOID, CUBE (Sex, Age, HI))
SELECT *, max(CASE WHEN subset = '' THEN total END) OVER (PARTITION BY GEOID) AS pop,
       round(total / max(CASE WHEN subset = '' THEN total END) OVER (PARTITION BY GEOID), 6) AS prop
FROM cubed""")
def subset_lattice(t: Tables) -> DataFrame:
    return rounded(subset_totals(I.leaves(t), "GEOID", DIMS, "estimate"))


@query("picked_subset_rows", f"""
WITH {I.L_SQL}, w AS (
  SELECT GEOID, variable, sum(estimate) OVER (PARTITION BY GEOID) AS pop, sum(estimate) OVER (PARTITION BY GEOID, Sex) AS sx,
         sum(estimate) OVER (PARTITION BY GEOID, Sex, Age) AS sxa FROM l WHERE {LEAF})
SELECT GEOID, variable, round(sx / pop, 6) AS prop_Sex, round(sxa / pop, 6) AS prop_Sex_Age FROM w
WHERE variable = 'B27001_026'""")
def picked_subset_rows(t: Tables) -> DataFrame:
    """Shares over all rows, read at one representative code."""
    rows = subset_shares(I.leaves(t), "GEOID", ["Sex", "Age"], "estimate", only=F.col("variable") == "B27001_026")
    return rounded(rows.select("GEOID", "variable", "prop_Sex", "prop_Sex_Age"))


@query("category_share_list", f"""
WITH {I.L_SQL}
SELECT GEOID, round(sum(CASE WHEN Age IN ('Under 6 years', '6 to 18 years') THEN estimate END) / sum(estimate), 6) AS prop_minor
FROM l WHERE {LEAF} GROUP BY 1 HAVING count(CASE WHEN Age IN ('Under 6 years', '6 to 18 years') THEN 1 END) > 0""")
def category_share_list(t: Tables) -> DataFrame:
    return rounded(category_share(I.leaves(t), "GEOID", "Age", ["Under 6 years", "6 to 18 years"], "estimate", "prop_minor"))


@query("category_share_pattern", f"""
WITH {I.L_SQL}
SELECT GEOID, round(sum(CASE WHEN regexp_matches(label, '(Female.*With)|(Under 6)') THEN estimate END) / sum(estimate), 6) AS prop_ess
FROM l WHERE {LEAF} GROUP BY 1 HAVING count(CASE WHEN regexp_matches(label, '(Female.*With)|(Under 6)') THEN 1 END) > 0""")
def category_share_pattern(t: Tables) -> DataFrame:
    rows = I.labelled(t).where(F.regexp_count("label", F.lit("!!")) == 4)
    return rounded(category_share(rows, "GEOID", "label", "(Female.*With)|(Under 6)", "estimate", "prop_ess"))


@query("two_level_share", f"""
WITH {I.L_SQL}, c AS (SELECT GEOID, HI, sum(estimate) AS count FROM l WHERE {LEAF} GROUP BY 1, 2)
SELECT GEOID, HI, count, sum(count) OVER (PARTITION BY GEOID) AS pop,
       round(count / sum(count) OVER (PARTITION BY GEOID), 6) AS prop FROM c""")
def two_level_share_query(t: Tables) -> DataFrame:
    return rounded(two_level_share(I.leaves(t), "GEOID", "HI", "estimate"))


@query("ordered_levels", f"""
WITH {I.L_SQL}, s AS (SELECT GEOID, round(sum(CASE WHEN HI = 'Yes' THEN estimate ELSE 0 END) / sum(estimate), 9) AS prop
                      FROM l WHERE {LEAF} GROUP BY 1)
SELECT GEOID, prop, row_number() OVER (ORDER BY prop, GEOID) AS level FROM s""")
def ordered_levels_query(t: Tables) -> DataFrame:
    shares = I.leaves(t).groupBy("GEOID").agg(
        F.round(F.sum(F.when(F.col("HI") == "Yes", F.col("estimate")).otherwise(0)) / F.sum("estimate"), 9).alias("prop"))
    return ordered_levels(shares, "GEOID", "prop")


@query("mean_above_share", f"""
WITH {I.L_SQL}, {I.ZIPS_SQL},
s AS (SELECT GEOID, sum(CASE WHEN HI = 'Yes' THEN estimate ELSE 0 END) / sum(estimate) AS share FROM l WHERE {LEAF} GROUP BY 1)
SELECT round(avg(CASE WHEN share > 0.5 THEN case_rate END), 6) AS mean_above, round(avg(case_rate), 6) AS mean_all,
       count(CASE WHEN share > 0.5 THEN 1 END) AS n_above
FROM s LEFT JOIN covid ON GEOID = zip""")
def mean_above_share(t: Tables) -> DataFrame:
    shares = I.leaves(t).groupBy("GEOID").agg(
        (F.sum(F.when(F.col("HI") == "Yes", F.col("estimate")).otherwise(0)) / F.sum("estimate")).alias("share"))
    table = shares.join(I.zip_cases(t), F.col("GEOID") == F.col("zip"), "left")
    return rounded(mean_above(table, "case_rate", "share", 0.5))


# ---------------------------------------------------------------- order


@query("top_customers", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_customers(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return top_k(totals, "total", 10, "o_custkey")


@query("lowest_balances", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey""")
def lowest_balances(t: Tables) -> DataFrame:
    """Sorted by an expression."""
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey")


# ---------------------------------------------------------------- scalar functions


@query("order_text_sheet", """
SELECT o_orderkey, o_orderstatus || ': ' || o_orderpriority AS joined, strftime(o_orderdate, '%B %d, %Y') AS long_date,
       strftime(o_orderdate, '%m/%d/%Y') AS short_date, CAST(o_orderdate AS DATE) AS parsed_long,
       CAST(o_orderdate AS DATE) AS parsed_short, regexp_replace(o_orderpriority, '^[0-9]-', '') AS priority,
       CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN substr(o_orderpriority, 1, 1) END AS urgent_digit,
       length(o_orderpriority) - length(replace(o_orderpriority, 'I', '')) AS letters,
       CAST(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT) AS DATE) AS week
FROM orders""")
def order_text_sheet(t: Tables) -> DataFrame:
    long = long_date("o_orderdate")
    post = F.concat(F.lit("Counts by State for "), long, F.lit(" ("))
    short = F.date_format("o_orderdate", "M/d/yy")
    return t.orders.select(
        "o_orderkey", F.concat("o_orderstatus", F.lit(": "), "o_orderpriority").alias("joined"), long.alias("long_date"),
        short_date("o_orderdate").alias("short_date"),
        parse_us_date(extract_or_null(post, r"by State for (\p{L}+ \d{2}, \d{4}) \(")).alias("parsed_long"),
        parse_us_date(short, "M/d/yy").alias("parsed_short"),
        F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("priority"),
        extract_or_null("o_orderpriority", "^([12])-").alias("urgent_digit"),
        F.regexp_count("o_orderpriority", F.lit("I")).cast("long").alias("letters"),
        sunday_week("o_orderdate").alias("week"))


@query("order_number_sheet", """
SELECT o_orderkey, round_even(o_totalprice, 1) AS one_digit, round_even(o_totalprice * power(10, 3 - floor(log10(o_totalprice))), 0)
       / power(10, 3 - floor(log10(o_totalprice))) AS four_digits,
       CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'high' END AS band,
       o_totalprice > 250000 AS above, abs(o_totalprice - 250000) AS gap
FROM orders""")
def order_number_sheet(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", half_even("o_totalprice", 1).alias("one_digit"), signif("o_totalprice", 4).alias("four_digits"),
        band("o_totalprice", [(100000, "low"), (300000, "medium")], "high").alias("band"),
        (F.col("o_totalprice") > 250000).alias("above"), F.abs(F.col("o_totalprice") - 250000).alias("gap"))


@query("range_midpoints", """
SELECT p_size, count(*) AS n, floor(p_size / 10) * 10 * 100 + 499.5 AS midpoint FROM part GROUP BY 1""")
def range_midpoints(t: Tables) -> DataFrame:
    """A published range such as ``1,000 - 1,999`` stands for its midpoint."""
    low = F.floor(F.col("p_size") / 10) * 10 * 100
    shown = F.concat(F.format_number(low, 0), F.lit(" - "), F.format_number(low + 999, 0))
    return t.part.select("p_size", range_midpoint(shown).alias("midpoint")).groupBy("p_size", "midpoint").agg(
        F.count(F.lit(1)).alias("n"))


@query("metric_titles", """
WITH m(code, title, axis) AS (VALUES """ + ", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in METRICS) + """),
e AS (SELECT ['cases', 'deaths', 'death_rate', 'case_rate', 'new_cases', 'moving_7_day_avg', 'avg_7_day_rate'][user_id % 7 + 1] AS code,
             value FROM events)
SELECT e.code, array_to_string(list_transform(string_split(e.code, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS menu_name,
       title, axis, count(*) AS n, round(sum(value), 4) AS total
FROM e JOIN m USING (code) GROUP BY ALL""")
def metric_titles(t: Tables) -> DataFrame:
    """Display names by lookup, menu names by title case."""
    names = lookup(t.spark, METRICS, "code string, title string, axis string")
    listed = ["cases", "deaths", "death_rate", "case_rate", "new_cases", "moving_7_day_avg", "avg_7_day_rate"]
    code = F.element_at(F.array(*[F.lit(c) for c in listed]), (F.col("user_id") % 7 + 1).cast("int"))
    sums = t.events.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(sums.join(F.broadcast(names), "code").select(
        "code", title_name("code").alias("menu_name"), "title", "axis", "n", "total"), 4)


# ---------------------------------------------------------------- windows on weekly sums


@query("weekly_means", f"""
WITH {I.panel_sql("before")},
w AS (SELECT state, CAST(date - CAST(dayofweek(date) AS INT) AS DATE) AS week, sum(new_cases) AS state_new_cases
      FROM panel GROUP BY 1, 2)
SELECT state, week, state_new_cases, round(CASE WHEN count(*) OVER x = 3 THEN avg(state_new_cases) OVER x END, 6) AS moving_3wk_avg
FROM w WINDOW x AS (PARTITION BY state ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def weekly_means(t: Tables) -> DataFrame:
    weeks = I.full_panel(t, "before").groupBy("state", sunday_week("date").alias("week")).agg(
        sum_strict("new_cases").alias("state_new_cases"))
    return rounded(weeks.withColumn("moving_3wk_avg", rolling_mean_strict("state_new_cases", ["state"], "week", 3)))
