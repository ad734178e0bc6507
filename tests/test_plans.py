"""What the physical plans must and must not hold."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from panelkit.operators import at_latest, category_share, cor_matrix, daily_new, rolling_rate, share, top_k
from panelkit.plans import acs_tidy, build_panel, feature_master, published, refresh_panel
from panelkit.plans.refresh import versions
from panelkit.plans.specs import CENSUS_TABLES, FEATURES
from panelkit.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    (spark.range(0, 400).selectExpr("concat('c', id % 4) county_name", "'IN' state", "date_add(date'2020-01-01', cast(id / 4 as int)) date",
                                    "cast(id as double) cases", "1000.0D population", "'x' unused").write.parquet(path))
    return spark.read.parquet(path)


def test_changes_and_means_share_one_exchange_and_sort(panel):
    text = plan(rolling_rate(daily_new(panel, ["county_name", "state"], "date", "cases")))
    assert count(r"Exchange hashpartitioning", text) == 1 and count(r"\bSort \[", text) == 1
    assert "unused" not in re.search(r"ReadSchema: (\S+)", plan(daily_new(panel.drop("unused"), ["county_name"], "date", "cases"))).group(1)


def test_long_panel_rows_are_never_shuffled(spark, tmp_path):
    """The one exchange of the flagship lies below the step that makes days out of counties."""
    (spark.range(0, 50).selectExpr("concat('c', id) `County Name`", "'IN' State", "'1' `2020-01-01`", "'2' `2020-01-02`")
     .write.parquet(str(tmp_path / "w")))
    wide = spark.read.parquet(str(tmp_path / "w"))
    pop = wide.selectExpr("`County Name`", "State", "10.0D population")
    text = plan(build_panel(wide, wide, pop))
    upper, lower = text.split("Generate ", 1)
    assert "Exchange" not in upper and count(r"Exchange hashpartitioning", lower) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        upper, lower = plan(build_panel(wide, wide, pop)).split("Generate ", 1)
        assert "Exchange" not in upper
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_newest_rows_need_no_join_and_no_window(panel):
    text = plan(at_latest(panel))
    assert "Join" not in text and "Window" not in text and "Subquery" in text


def test_category_share_is_one_aggregate(panel):
    text = plan(category_share(panel, "county_name", "unused", ["x"], "cases", "p"))
    assert count(r"Exchange hashpartitioning", text) == 1 and "Window" not in text and "partial_sum" in text


def test_share_does_not_window_raw_rows(panel):
    assert "Window" not in plan(share(panel, "county_name", "cases"))


def test_matrix_reads_the_data_once(panel):
    text = plan(cor_matrix(panel, ["cases", "population"]))
    assert count("FileScan", text) == 0   # the one pass is over; what is left is a matrix


def test_top_k_keeps_k_rows_per_task(panel):
    assert "TakeOrderedAndProject" in plan(top_k(panel, "cases", 3, "date"))


def test_features_need_one_pass_over_census_rows(spark, tmp_path):
    rows = spark.createDataFrame([("1", "B27001_038", 1.0)], "GEOID string, variable string, estimate double")
    rows.write.parquet(str(tmp_path / "acs"))
    rows.selectExpr("variable", "'Estimate!!Total!!Female!!19 to 25 years!!With health insurance coverage' label").write.parquet(str(tmp_path / "names"))
    acs, names = spark.read.parquet(str(tmp_path / "acs")), spark.read.parquet(str(tmp_path / "names"))
    text = plan(feature_master(acs, names, None, FEATURES))
    assert count(r"FileScan parquet \[GEOID", text) == 1 and count(r"Exchange hashpartitioning\(GEOID", text) == 1
    assert "SortMergeJoin" not in text
    tidy = plan(acs_tidy(acs, names, CENSUS_TABLES["insurance"]))
    assert "StringStartsWith(variable,B27001_)" in tidy and "BroadcastHashJoin" in tidy


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    if name in ("lasso_terms", "stepwise_terms", "backward_terms"):
        pytest.skip("the result is a small table built after the pass")
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["orders_predicate"](spark, FOLDER))
    assert "PushedFilters" in text and "GreaterThanOrEqual(o_totalprice,100000.0)" in text
    assert "o_orderpriority" in text and "o_custkey" not in text


# ---------------------------------------------------------------- the panel kept up to date

def wide_tables(spark, counts, days):
    """Wide cases and deaths of ``{(county, state): [counts]}``."""
    names = ", ".join(["`County Name` string", "State string", *[f"`{d}` string" for d in days]])
    cases = spark.createDataFrame([(*k, *[None if x is None else f"{x:,}" for x in v]) for k, v in counts.items()], names)
    deaths = spark.createDataFrame([(*k, *[None if x is None else str(x // 10) for x in v]) for k, v in counts.items() if k[0] != "B"], names)
    return cases, deaths


def test_refreshed_panel_equals_a_full_rebuild_and_touches_little(spark, tmp_path):
    draw = random.Random(3)
    days = [str(dt.date(2024, 1, 20) + dt.timedelta(days=i)) for i in range(70)]
    counts = {}
    for county, state in [("A", "IN"), ("B", "IN"), ("C", "OH"), ("D", "OH"), ("E", "KY"), ("Statewide Unallocated", "KY")]:
        total, own = 0, []
        for _ in days:
            total += draw.randint(-2, 40)
            own.append(total if draw.random() > 0.02 else None)
        counts[county, state] = own
    pop = spark.createDataFrame([(c, s, 1000.0 * (i + 1)) for i, (c, s) in enumerate(counts)], "`County Name` string, State string, population double")
    path = str(tmp_path / "panel")
    assert published(spark, path) is None

    def refreshed(known, upto, people=pop):
        tables = wide_tables(spark, {k: v[:upto] for k, v in known.items()}, days[:upto])
        got = refresh_panel(*tables, people, path, states=None)
        want = build_panel(*tables, people, states=None)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        return {(r["version"], r["in_state"], r["month"]) for r in spark.read.parquet(f"{path}/lists/{versions(spark, path)[-1]}").collect()}

    assert {v for v, _, _ in refreshed(counts, 60)} == {1}
    assert versions(spark, path) == [1] and refreshed(counts, 60) and versions(spark, path) == [1]   # nothing new, nothing written
    # new days: the last month of every state, and nothing before
    assert refreshed(counts, 66) == {(1, s, m) for s in ("IN", "OH", "KY") for m in ("2024-01", "2024-02")} | {(2, s, "2024-03") for s in ("IN", "OH", "KY")}
    # a correction in February of one county: its state from February on
    fixed = {**counts, ("C", "OH"): [x if i != 25 else 5 for i, x in enumerate(counts["C", "OH"])]}
    listed = refreshed(fixed, 66)
    assert {p for p in listed if p[0] == 3} == {(3, "OH", "2024-02"), (3, "OH", "2024-03")}
    # a county that is gone, another population, and a refresh that was cut short before
    (tmp_path / "panel" / "panel" / "version=4" / "in_state=IN" / "month=2024-01").mkdir(parents=True)
    fewer = {k: v for k, v in fixed.items() if k[0] != "E"}
    more = pop.withColumn("population", F.when(F.col("County Name") == "A", 5.0).otherwise(F.col("population")))
    assert {p[1] for p in refreshed(fewer, 70, more) if p[0] < 4} == {"OH"}
    assert published(spark, path, 1).count() == 5 * 60
    with pytest.raises(ValueError, match="lack"):
        refresh_panel(*wide_tables(spark, {k: v[:40] for k, v in counts.items()}, days[:40]), pop, path, states=None)
