"""Census rows are formed in as many partitions as the lines need, an area's groups all in one of them."""

import re

import pytest
from pyspark.sql import functions as F

from panelkit.queries import inputs as I
from panelkit.queries import QUERIES
from panelkit.queries.census import estimates
from panelkit.queries.registry import Tables

LINES = [(i % 90, i % 37 if i % 50 else None, i % 7 if i % 41 else None, i % 4, float(i % 9), "NAR"[i % 3], "FO"[i % 2]) for i in range(600)]
ORDERS = [(i, i % 11, f"{i % 5 + 1}-X" if i % 13 else None) for i in range(90)]


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "ROWS", 50)
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                          "l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    return Tables(spark, str(tmp_path))


def shuffles(df):
    """Why and into how many partitions the rows of a plan are dealt."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (\w+)", text)


def together(df):
    places = df.groupBy(F.col("GEOID")).agg(F.count_distinct("part").alias("n"))
    return {r.n for r in places.collect()} == {1}


def key(k):
    return None if k is None else f"{k:08d}"


def test_estimates_of_a_supplier_are_formed_in_one_partition(tables):
    rows = estimates(tables)
    assert shuffles(rows) == [("12", "REPARTITION_BY_NUM")] * 2
    assert together(rows.withColumn("part", F.spark_partition_id()))
    got = {(r.GEOID, r.variable): r.estimate for r in rows.collect()}
    want = {}
    for _, part, supp, line, q, *_ in LINES:
        if part is not None:
            want[key(supp)] = want.get(key(supp), 0.0) + q
            leaf = (part * 7 + line) % 5040 % 16
            want[key(supp), leaf] = want.get((key(supp), leaf), 0.0) + q
    for k, q in want.items():
        assert got[(k[0], f"B19101_{k[1] + 2:03d}") if isinstance(k, tuple) else (k, "B19101_001")] == q
    assert {v for k, v in got.items() if k[1] == "B23001_001"} == {v for k, v in want.items() if not isinstance(k, tuple)}


@pytest.mark.parametrize("name", ["published_feature_master", "tidy_education", "tidy_gini", "tidy_income"])
def test_published_tables_deal_lines_by_their_number(tables, name):
    large = [s for s in shuffles(QUERIES[name](tables.spark, tables.folder)) if s[0] == "12"]
    assert large == [("12", "REPARTITION_BY_NUM")] * 2


def test_lattice_is_formed_where_the_census_rows_of_an_area_lie(tables):
    df = QUERIES["subset_lattice"](tables.spark, tables.folder)
    assert together(df.withColumn("part", F.spark_partition_id()))
    # the two tables, the leaves and their areas; the dictionary's own are dealt by the session
    assert [s for s in shuffles(df) if s[0] == "12"] == [("12", "REPARTITION_BY_NUM")] * 4
    custs = {o: (c, p) for o, c, p in ORDERS}
    want = {}
    for order, _, _, _, q, flag, status in LINES:
        cust, priority = custs[order]
        if priority is not None:
            cell = ["Female" if status == "F" else "Male", int(priority[0]) - 1, "No" if flag == "N" else "Yes"]
            for dims, k in (("", (None, None, None)), ("Sex", (cell[0], None, None)), ("Age", (None, I.AGES[cell[1]], None)),
                            ("Sex+HI", (cell[0], None, cell[2])), ("Sex+Age+HI", (cell[0], I.AGES[cell[1]], cell[2]))):
                want[key(cust), dims, k] = want.get((key(cust), dims, k), 0.0) + q
    got = {(r.GEOID, r.subset, (r.Sex, r.Age, r.HI)): (r.total, r["pop"]) for r in df.collect()}
    assert {k: v[0] for k, v in got.items() if k[1] in ("", "Sex", "Age", "Sex+HI", "Sex+Age+HI")} == want
    assert all(v[1] == want[k[0], "", (None, None, None)] for k, v in got.items())


def test_a_missing_age_is_not_the_sum_over_ages(tables):
    # orders without a priority: a row of the sex, one of the missing age, one for each coverage
    lines = [(x, custs) for x in LINES for custs in [dict((o, (c, p)) for o, c, p in ORDERS)[x[0]]] if custs[0] == 0 and x[6] == "F"]
    without = [x for x, (_, p) in lines if p is None]
    sums = [sum(x[4] for x, _ in lines), sum(x[4] for x in without)]
    for hit in (True, False):
        some = [x[4] for x in without if (x[5] == "N") == hit]
        sums += [sum(some)] if some else []
    rows = I.census_rows(tables).where("GEOID = '00000000' AND variable = 'B27001_018'").collect()
    assert without and sorted(r.estimate for r in rows) == sorted(sums)
