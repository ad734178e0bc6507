"""Sources, projections, filters, joins and reshaping."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F, types as T

from panelkit.functions import (
    canonical, clean_number, code_list, decensor, flag, group_of, label_depth, last_part, number_text,
)
from panelkit.operators import (
    at_date, at_latest, cols_like, drop_empty_columns, drop_in, full_join_all, keep_in, latest_column, melt_panel,
    menu, natural_join, recode, rename_like, split_label, split_unallocated, spread, without_outliers,
)
from panelkit.plans.specs import CITY_MARKERS, STATE_NAMES
from panelkit.queries import inputs as I
from panelkit.queries.registry import query, rounded, Tables
from panelkit.session import scratch_path
from panelkit.sources import acs_table, extract_links, first_links, lookup, read_table, read_wide, read_wide_panel, write_table

# ---------------------------------------------------------------- sources and sinks


@query("orders_by_status", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def orders_by_status(t: Tables) -> DataFrame:
    schema = T.StructType([T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    rows = read_table(t.spark, f"{t.folder}/orders.parquet", schema)
    return rounded(rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("wide_text_round_trip", f"""
WITH {I.E_SQL} SELECT county_name, state, date, cases FROM e""")
def wide_text_round_trip(t: Tables) -> DataFrame:
    """Counts to a wide text file with thousands commas, and back to a long panel."""
    days = I.event_days(t)
    path = scratch_path(t.spark, "wide")
    write_table(I.wide_file(I.event_counts(t, days), "cases", days), path, "csv")
    wide = read_wide(t.spark, path, ["County Name", "State"])
    wide = wide.withColumnsRenamed({"County Name": "county_name", "State": "state"})
    return melt_panel(wide, I.KEYS, "cases").withColumn("cases", clean_number("cases"))


@query("wide_files_read", f"""
WITH {I.E_SQL} SELECT county_name, state, date, cases FROM e
WHERE state IN ('NATION_1', 'NATION_4', 'NATION_7', 'NATION_12', 'NATION_20') AND date >= DATE '2024-01-11' AND date < DATE '2024-01-21'""")
def wide_files_read(t: Tables) -> DataFrame:
    """Counts to many wide files, one for each state and third of the calendar, so that headers differ; read back as long rows,
    states and dates chosen by the reader, which takes the filters from the plan."""
    days = I.event_days(t)
    counts = I.event_counts(t, days)
    path = scratch_path(t.spark, "wide")
    for i in range(3):
        wide = I.wide_file(counts, "cases", days[i::3]).withColumn("part", F.col("State"))
        wide.repartition("part").write.mode("append").option("header", True).partitionBy("part").csv(f"{path}/{i}")
    rows = read_wide_panel(t.spark, path, ["County Name", "State"], push=True)
    some = rows.filter(F.col("State").isin("NATION_1", "NATION_4", "NATION_7", "NATION_12", "NATION_20")
                       & (F.col("date") >= F.lit(dt.date(2024, 1, 11))) & (F.col("date") < F.lit(dt.date(2024, 1, 21))))
    return some.select(F.col("County Name").alias("county_name"), F.col("State").alias("state"), "date", clean_number("value").alias("cases"))


@query("inferred_text_read", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(CAST(o_orderdate AS DATE)) AS first_date
FROM orders GROUP BY 1""")
def inferred_text_read(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders") + ".csv"
    write_table(t.orders.select("o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("day")), path, "csv")
    rows = read_table(t.spark, path)
    return rounded(rows.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("day").alias("first_date")), 2, "total")


HREF_SQL = r"""hrefs AS (
  SELECT page_id, list, unnest(range(len(list))) AS pos
  FROM (SELECT page_id, regexp_extract_all(html,
    '(?i)<a(?:\s+[^\s"''>=/]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?)*?\s+href\s*=\s*((?:"[^"]*"|''[^'']*''|[^\s"''>]+))', 1) AS list
    FROM pages)),
links AS (SELECT page_id, CAST(pos AS INT) AS pos,
  replace(replace(replace(replace(trim(list[pos + 1], '"'''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS href FROM hrefs)"""



@query("page_links", f"""
WITH {HREF_SQL} SELECT page_id, pos, href FROM links WHERE regexp_matches(href, '^/t')""")
def page_links(t: Tables) -> DataFrame:
    return extract_links(t.pages, "^/t")


@query("page_first_links", f"""
WITH {HREF_SQL}
SELECT page_id, arg_min(href, pos) FILTER (WHERE contains(href, 'the')) AS the,
       arg_min(href, pos) FILTER (WHERE contains(href, 'an')) AS an
FROM links GROUP BY 1""")
def page_first_links(t: Tables) -> DataFrame:
    return first_links(extract_links(t.pages, "."), ["the", "an"])


@query("census_table_of_areas", f"""
WITH {I.L_SQL}
SELECT GEOID, variable, estimate FROM l
WHERE variable <> 'B27001_001' AND GEOID IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer
                                             WHERE c_mktsegment = 'BUILDING')""")
def census_table_of_areas(t: Tables) -> DataFrame:
    areas = (t.customer.where(F.col("c_mktsegment") == "BUILDING")
             .select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("GEOID")))
    return acs_table(I.census_rows(t), "B27001", areas, ["B27001_001"])


@query("parquet_round_trip", """
SELECT l_returnflag, l_shipmonth, count(*) AS n, sum(l_quantity) AS qty
FROM (SELECT l_returnflag, l_quantity, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) GROUP BY 1, 2""")
def parquet_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "flags")
    rows = t.lineitem.select("l_returnflag", "l_quantity", F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"))
    write_table(rows, path, partition_by=["l_returnflag"])
    back = read_table(t.spark, path, "l_quantity double, l_shipmonth string, l_returnflag string")
    return back.groupBy("l_returnflag", "l_shipmonth").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("state_name_lookup", """
WITH states(State, Abb, code) AS (VALUES """ + ", ".join(
    f"('{name}', '{abb}', {i})" for i, (name, abb) in enumerate(STATE_NAMES)) + """)
SELECT State, Abb, count(*) AS customers FROM customer JOIN states ON c_nationkey = code GROUP BY 1, 2""")
def state_name_lookup(t: Tables) -> DataFrame:
    rows = [(name, abb, i) for i, (name, abb) in enumerate(STATE_NAMES)]
    states = lookup(t.spark, rows, "State string, Abb string, code int")
    return (t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
            .join(F.broadcast(states), F.col("c_nationkey") == F.col("code")).select("State", "Abb", "customers"))


@query("marker_lookup", """
WITH marks(City, Lat, Long, code) AS (VALUES """ + ", ".join(
    f"('{c}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {i})" for i, (c, a, b) in enumerate(CITY_MARKERS)) + """)
SELECT City, Lat, Long, count(*) AS suppliers
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN marks ON n_nationkey % 8 = code GROUP BY 1, 2, 3""")
def marker_lookup(t: Tables) -> DataFrame:
    rows = [(*m, i) for i, m in enumerate(CITY_MARKERS)]
    marks = lookup(t.spark, rows, "City string, Lat double, Long double, code int")
    per = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return (per.join(F.broadcast(marks), F.col("s_nationkey") % 8 == F.col("code"))
            .groupBy("City", "Lat", "Long").agg(F.sum("n").alias("suppliers")))


# ---------------------------------------------------------------- projections and cleaning


@query("customer_projection", """
SELECT c_custkey, c_name, c_acctbal, c_acctbal / 100 AS hundreds FROM customer""")
def customer_projection(t: Tables) -> DataFrame:
    """Drop by name, put the key first, add a derived column."""
    rows = t.customer.drop("c_nationkey", "c_mktsegment")
    first = ["c_custkey"]
    return rows.select(*first, *[c for c in rows.columns if c not in first]).withColumn("hundreds", F.col("c_acctbal") / 100)


@query("lineitem_without_keys", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS l_quantity
FROM lineitem GROUP BY 1, 2""")
def lineitem_without_keys(t: Tables) -> DataFrame:
    rows = t.lineitem.drop(*cols_like(t.lineitem, suffix="key"))
    flags, numbers = cols_like(rows, contains="status") + ["l_returnflag"], cols_like(rows, suffix="quantity")
    return rows.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in numbers])


@query("latest_wide_column", f"""
WITH {I.E_SQL} SELECT county_name AS "County Name", state AS "State", cases AS "Cases" FROM e
WHERE date = (SELECT max(date) FROM e)""")
def latest_wide_column(t: Tables) -> DataFrame:
    days = I.event_days(t)
    wide = I.wide_file(I.event_counts(t, days), "cases", days)
    return latest_column(wide, ["County Name", "State"], "Cases").withColumn("Cases", clean_number("Cases"))


@query("renamed_columns", f"""
WITH {I.L_SQL}
SELECT GEOID, max(estimate) FILTER (WHERE variable = 'B27001_002') AS pop_male,
       max(estimate) FILTER (WHERE variable = 'B27001_018') AS pop_female FROM l GROUP BY 1""")
def renamed_columns(t: Tables) -> DataFrame:
    wide = spread(I.census_rows(t), ["GEOID"], "variable", "estimate", ["B27001_002", "B27001_018"])
    wide = rename_like(rename_like(wide, "^B27001_002$", "male"), "^B27001_018$", "female")
    return rename_like(wide, "^(male|female)$", r"pop_\1")


@query("cleaned_numbers", """
SELECT o_orderkey, round_even(o_totalprice, 0) AS total FROM orders""")
def cleaned_numbers(t: Tables) -> DataFrame:
    """Totals printed with thousands commas and stray blanks, then read back."""
    printed = F.concat(F.format_number(F.bround("o_totalprice", 0), 0), F.lit("\t"))
    return t.orders.select("o_orderkey", clean_number(printed).alias("total"))


@query("decensored_values", """
SELECT event_id, CASE WHEN value <= 5 THEN 5 ELSE value END AS value FROM events""")
def decensored_values(t: Tables) -> DataFrame:
    shown = F.when(F.col("value") <= 5, F.lit("<=5")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", decensor(shown, "<=5", 5).alias("value"))


@query("canonical_names", """
SELECT replace(replace(p_name, 'widget', 'Widget'), 'small ', 'Small ') AS name, count(*) AS n FROM part GROUP BY 1""")
def canonical_names(t: Tables) -> DataFrame:
    name = canonical("p_name", {"widget": "Widget", "small ": "Small "})
    return t.part.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("recoded_flags", """
SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS l_returnflag,
       CASE l_linestatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE l_linestatus END AS l_linestatus,
       sum(l_quantity) AS qty
FROM lineitem GROUP BY 1, 2""")
def recoded_flags(t: Tables) -> DataFrame:
    names = lookup(t.spark, [("A", "accepted"), ("R", "returned"), ("F", "filled"), ("O", "open")], "code string, text string")
    sums = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return recode(recode(sums, "l_returnflag", names), "l_linestatus", names)


HOLES_SQL = """holes AS (
  SELECT c_custkey, c_nationkey, n, total
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders
                           WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey)"""


def _holes(t: Tables) -> DataFrame:
    pending = (t.orders.where(F.col("o_orderstatus") == "P").groupBy("o_custkey")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))
    return (t.customer.join(pending, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select("c_custkey", "c_nationkey", "n", "total"))


@query("incomplete_dropped", f"""
WITH {HOLES_SQL} SELECT c_custkey, c_nationkey, n, round(total, 2) AS total FROM holes WHERE n IS NOT NULL""")
def incomplete_dropped(t: Tables) -> DataFrame:
    return rounded(_holes(t).dropna("any"), 2)


@query("missing_filled", f"""
WITH {HOLES_SQL} SELECT c_custkey, c_nationkey, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) AS total FROM holes""")
def missing_filled(t: Tables) -> DataFrame:
    return rounded(_holes(t).fillna({"n": 0, "total": 0.0}), 2)


@query("aligned_keys", """
SELECT n_name, count(*) AS n, round(avg(s_acctbal), 4) AS mean_balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def aligned_keys(t: Tables) -> DataFrame:
    """Join a text key with a numeric one: both become text."""
    left = t.supplier.withColumn("key", F.col("s_nationkey").cast("string"))
    right = t.nation.select("n_name", F.col("n_nationkey").cast("string").alias("key"))
    return rounded(left.join(right, "key").groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("mean_balance")), 4)


@query("empty_columns_dropped", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def empty_columns_dropped(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderstatus", "o_orderpriority", F.nullif("o_orderstatus", "o_orderstatus").alias("blank"))
    kept = drop_empty_columns(rows)
    return kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- filters


@query("segment_members", """
SELECT c_mktsegment IN ('BUILDING', 'MACHINERY') AS member, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer GROUP BY 1""")
def segment_members(t: Tables) -> DataFrame:
    """A constant list and its negation."""
    chosen = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")]
    inside = t.customer.where(chosen).groupBy(F.lit(True).alias("member")).agg(*sums)
    outside = t.customer.where(~chosen).groupBy(F.lit(False).alias("member")).agg(*sums)
    return rounded(inside.unionByName(outside), 2)


@query("customers_with_pending", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def customers_with_pending(t: Tables) -> DataFrame:
    pending = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return keep_in(t.customer, pending, "c_custkey").select("c_custkey", "c_name")


@query("customers_without_pending", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def customers_without_pending(t: Tables) -> DataFrame:
    pending = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return drop_in(t.customer, pending, "c_custkey").select("c_custkey", "c_name")


@query("documents_by_pattern", r"""
SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')) AS with_number,
       count(*) FILTER (WHERE NOT regexp_matches(text, '[0-9]{3}-[0-9]{4}')) AS without_number,
       count(*) FILTER (WHERE regexp_matches(text, '^[A-Z]')) AS capital
FROM documents GROUP BY 1""")
def documents_by_pattern(t: Tables) -> DataFrame:
    number = F.col("text").rlike("[0-9]{3}-[0-9]{4}")
    return t.documents.groupBy("lang").agg(
        F.count_if(number).alias("with_number"), F.count_if(~number).alias("without_number"),
        F.count_if(F.col("text").rlike("^[A-Z]")).alias("capital"))


@query("rows_by_label_depth", f"""
WITH {I.L_SQL}
SELECT CAST((length(label) - length(replace(label, '!!', ''))) / 2 AS INT) AS depth, count(*) AS n, sum(estimate) AS total
FROM l GROUP BY 1""")
def rows_by_label_depth(t: Tables) -> DataFrame:
    return I.labelled(t).groupBy(label_depth("label").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimate").alias("total"))


@query("orders_predicate", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_orderdate >= TIMESTAMP '1998-01-01'
  AND o_orderpriority <> '5-LOW' AND o_totalprice BETWEEN 100000 AND 400000""")
def orders_predicate(t: Tables) -> DataFrame:
    return t.orders.where(
        ((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT"))
        & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("o_orderpriority") != "5-LOW")
        & F.col("o_totalprice").between(100000, 400000)).select("o_orderkey", "o_totalprice")


@query("codes_in_range", f"""
WITH {I.L_SQL}
SELECT variable, sum(estimate) AS total, count(*) AS n FROM l
WHERE CAST(right(variable, 3) AS INT) BETWEEN 3 AND 17 GROUP BY 1""")
def codes_in_range(t: Tables) -> DataFrame:
    """A numeric range over a key that is kept as text."""
    number = F.substring("variable", -3, 3).try_cast("int")
    return I.census_rows(t).where(number.between(3, 17)).groupBy("variable").agg(
        F.sum("estimate").alias("total"), F.count(F.lit(1)).alias("n"))


@query("rows_by_code_list", f"""
WITH {I.L_SQL}
SELECT GEOID, variable, estimate FROM l
WHERE variable IN ('B27001_002', 'B27001_010', 'B27001_018', 'B27001_019', 'B27001_020', 'B27001_021')""")
def rows_by_code_list(t: Tables) -> DataFrame:
    return acs_table(I.census_rows(t), "B27001", codes=code_list("B27001", 2, 10, range(18, 22)))


@query("panel_latest", f"""
WITH {I.panel_sql()}
SELECT county_name, state, date, cases, new_cases, round(avg_7_day_rate, 6) AS avg_7_day_rate FROM panel
WHERE date = (SELECT max(date) FROM panel)""")
def panel_latest(t: Tables) -> DataFrame:
    rows = at_latest(I.full_panel(t))
    return rounded(rows.select("county_name", "state", "date", "cases", "new_cases", "avg_7_day_rate"))


@query("panel_at_date", f"""
WITH {I.panel_sql()}
SELECT county_name, state, date, cases, deaths, round(case_rate, 6) AS case_rate FROM panel WHERE date = DATE '1998-06-15'""")
def panel_at_date(t: Tables) -> DataFrame:
    rows = at_date(I.full_panel(t), "date", "1998-06-15")
    return rounded(rows.select("county_name", "state", "date", "cases", "deaths", "case_rate"))


@query("unallocated_split", f"""
WITH {I.E_SQL}
SELECT state, date, sum(CASE WHEN county_name LIKE '%Statewide Unallocated%' THEN 0 ELSE cases END) AS allocated,
       sum(CASE WHEN county_name LIKE '%Statewide Unallocated%' THEN cases ELSE 0 END) AS unallocated
FROM e GROUP BY 1, 2""")
def unallocated_split(t: Tables) -> DataFrame:
    counts = I.event_counts(t, I.event_days(t)).withColumn("cases", F.col("cases").cast("double"))
    known, rest = split_unallocated(counts)
    a = known.groupBy("state", "date").agg(F.sum("cases").alias("allocated"))
    b = rest.groupBy("state", "date").agg(F.sum("cases").alias("unallocated"))
    return a.join(b, ["state", "date"], "full").fillna(0.0)


NATION_REVENUE = """revenue AS (
  SELECT n_name, sum(o_totalprice) AS revenue, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""


def _nation_revenue(t: Tables) -> DataFrame:
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "revenue", "n"))


@query("outliers_removed", """
SELECT c_custkey, round(total, 2) AS total FROM (
  SELECT c_custkey, c_mktsegment, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
WHERE total < 3000000 AND c_mktsegment <> 'FURNITURE'
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 499000)""")
def outliers_removed(t: Tables) -> DataFrame:
    totals = (t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
              .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    kept = without_outliers(totals, "total", above=3000000, ids=("c_mktsegment", ["FURNITURE"]))
    extreme = t.orders.where(F.col("o_totalprice") > 499000).select(F.col("o_custkey").alias("c_custkey"))
    return rounded(without_outliers(kept, "total", ids=extreme).select("c_custkey", "total"), 2)


# ---------------------------------------------------------------- joins


@query("customer_left_orders", """
SELECT c_custkey, c_name, n, round(total, 2) AS total
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
  ON o_custkey = c_custkey""")
def customer_left_orders(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
                   .select("c_custkey", "c_name", "n", "total"), 2)


@query("composite_key_join", f"""
WITH {I.P_SQL}
SELECT county_name, state, date, d.n AS cases, x.d AS deaths, population
FROM daily d LEFT JOIN (SELECT county_name, state, date, d FROM daily WHERE d > 0) x USING (county_name, state, date)
LEFT JOIN people USING (county_name, state)""")
def composite_key_join(t: Tables) -> DataFrame:
    counts = I.daily_counts(t)
    cases = counts.select(*I.KEYS, "date", F.col("n").alias("cases"))
    deaths = counts.where("d > 0").select(*I.KEYS, "date", F.col("d").alias("deaths"))
    return cases.join(deaths, [*I.KEYS, "date"], "left").join(I.people(t), I.KEYS, "left")


@query("nation_master", f"""
WITH {NATION_REVENUE},
c AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1),
s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT n.n_name, r_name, customers, suppliers, round(revenue, 2) AS revenue
FROM nation n LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c_nationkey = n_nationkey
LEFT JOIN s ON s_nationkey = n_nationkey LEFT JOIN revenue USING (n_name)""")
def nation_master(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rounded(names.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
                   .join(_nation_revenue(t), "n_name", "left")
                   .select("n_name", "r_name", "customers", "suppliers", "revenue"), 2)


@query("order_customer_inner", """
SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def order_customer_inner(t: Tables) -> DataFrame:
    return rounded(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
                   .groupBy("c_mktsegment", "o_orderpriority")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("natural_join_panels", f"""
WITH {I.P_SQL}
SELECT a.county_name, a.state, a.date, a.n AS cases, b.d AS deaths
FROM daily a JOIN (SELECT county_name, state, date, d FROM daily WHERE d > 0) b
  ON a.county_name = b.county_name AND a.state = b.state AND a.date = b.date""")
def natural_join_panels(t: Tables) -> DataFrame:
    counts = I.daily_counts(t)
    return natural_join(counts.select(*I.KEYS, "date", F.col("n").alias("cases")),
                        counts.where("d > 0").select(*I.KEYS, "date", F.col("d").alias("deaths")))


@query("full_join_of_customers", """
WITH a AS (SELECT o_custkey AS k, count(*) AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
c AS (SELECT o_custkey AS k, count(*) AS large FROM orders WHERE o_totalprice > 450000 GROUP BY 1)
SELECT k, pending, urgent, large FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def full_join_of_customers(t: Tables) -> DataFrame:
    def per(name: str, condition) -> DataFrame:
        return t.orders.where(condition).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(name))

    return full_join_all([per("pending", F.col("o_orderstatus") == "P"), per("urgent", F.col("o_orderpriority") == "1-URGENT"),
                          per("large", F.col("o_totalprice") > 450000)], "k")


@query("dictionary_join", f"""
WITH {I.L_SQL} SELECT GEOID, variable, label, estimate FROM l""")
def dictionary_join(t: Tables) -> DataFrame:
    return I.labelled(t).select("GEOID", "variable", "label", "estimate")


@query("payload_join", """
SELECT c_custkey, n_name, 'POINT(' || n_nationkey || ' ' || n_regionkey || ')' AS geometry
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def payload_join(t: Tables) -> DataFrame:
    """An opaque payload travels along a key."""
    shapes = t.nation.select("n_nationkey", "n_name", F.concat(
        F.lit("POINT("), F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_regionkey").cast("string"),
        F.lit(")")).cast("binary").alias("geometry"))
    return (t.customer.join(shapes, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("c_custkey", "n_name", F.col("geometry").cast("string").alias("geometry")))


# ---------------------------------------------------------------- reshaping


@query("melted_panel", f"""
WITH {I.E_SQL} SELECT county_name, state, date, deaths FROM e""")
def melted_panel(t: Tables) -> DataFrame:
    days = I.event_days(t)
    wide = I.wide_file(I.event_counts(t, days), "deaths", days)
    wide = wide.withColumnsRenamed({"County Name": "county_name", "State": "state"})
    return melt_panel(wide, I.KEYS, "deaths").withColumn("deaths", clean_number("deaths"))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("region_columns", f"""
WITH {I.P_SQL}, s AS (SELECT date, state, CAST(sum(n) AS BIGINT) AS n FROM daily GROUP BY 1, 2)
SELECT date, """ + ", ".join(f"max(n) FILTER (WHERE state = '{x}') AS \"{x}\"" for x in REGIONS) + " FROM s GROUP BY 1")
def region_columns(t: Tables) -> DataFrame:
    sums = I.daily_counts(t).groupBy("date", "state").agg(F.sum("n").alias("n"))
    return spread(sums, ["date"], "state", "n", REGIONS)


PICKED = ["B27001_010", "B27001_026"]


@query("codes_to_columns", f"""
WITH {I.L_SQL}, tot AS (SELECT GEOID, max(estimate) FILTER (WHERE variable = 'B27001_001') AS whole FROM l GROUP BY 1)
SELECT GEOID, """ + ", ".join(
    f"max(estimate) FILTER (WHERE variable = '{c}') AS estimate_{c}, "
    f"round(max(estimate / whole) FILTER (WHERE variable = '{c}'), 6) AS prop_{c}" for c in PICKED) + """
FROM l JOIN tot USING (GEOID) WHERE variable IN ('B27001_010', 'B27001_026') GROUP BY 1""")
def codes_to_columns(t: Tables) -> DataFrame:
    """Two value columns per code, folded to one row per area by the first value present."""
    rows = I.census_rows(t)
    whole = rows.where(F.col("variable") == "B27001_001").select("GEOID", F.col("estimate").alias("whole"))
    chosen = rows.where(F.col("variable").isin(PICKED)).join(whole, "GEOID")
    chosen = chosen.withColumn("prop", F.try_divide("estimate", "whole"))
    return rounded(spread(chosen, ["GEOID"], "variable", ["estimate", "prop"], PICKED))


@query("split_labels", f"""
WITH {I.L_SQL}
SELECT variable, 'Estimate' AS kind, 'Total' AS whole, Sex, Age, count(*) AS n, sum(estimate) AS total FROM l GROUP BY ALL""")
def split_labels(t: Tables) -> DataFrame:
    """Five parts named, four kept; parts a short label lacks are NULL."""
    parts = split_label(I.labelled(t), "label", ["kind", "whole", "Sex", "Age"])
    return parts.groupBy("variable", "kind", "whole", "Sex", "Age").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimate").alias("total"))


@query("customer_menu", """
SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY 1""")
def customer_menu(t: Tables) -> DataFrame:
    return menu(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


# ---------------------------------------------------------------- label functions on whole texts


@query("label_functions", f"""
WITH {I.L_SQL}
SELECT variable, regexp_replace(label, '^.*!!', '') AS last, replace(label, 'Estimate!!Total!!', '') AS rest,
       CASE WHEN HI = 'No' THEN 'No' WHEN HI = 'Yes' THEN 'Yes' END AS covered,
       CASE WHEN Age IN ('Under 6 years', '6 to 18 years') THEN 'minor' WHEN Age IS NOT NULL THEN 'adult' END AS band,
       CAST(CAST(max(estimate) AS BIGINT) AS VARCHAR) AS largest
FROM l GROUP BY variable, label, HI, Age""")
def label_functions(t: Tables) -> DataFrame:
    rows = split_label(I.labelled(t).withColumn("text", F.col("label")), "label", ["e", "t", "Sex", "Age", "Cover"])
    return rows.groupBy("variable", "text", "Age", "Cover").agg(F.max("estimate").alias("top")).select(
        "variable", last_part("text").alias("last"), F.replace("text", F.lit("Estimate!!Total!!"), F.lit("")).alias("rest"),
        flag("Cover", "No health insurance coverage").alias("covered"),
        group_of("Age", {"minor": ["Under 6 years", "6 to 18 years"]}, "adult").alias("band"),
        number_text("top", 0).alias("largest"))
