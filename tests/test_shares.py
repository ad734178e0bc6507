"""Shares, subset shares and the census composites."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelkit.operators import category_share, mean_above, share, subset_shares, subset_totals, two_level_share, with_total
from panelkit.plans import acs_tidy, ancestry_shares, city_report, city_study, feature_block, feature_master, predict_case_rate, split_place
from panelkit.plans.specs import CENSUS_TABLES, CITY_CATEGORIES, FEATURES, CategorySpec


def cells(spark, rows):
    return spark.createDataFrame(rows, "g string, sex string, age string, v double")


ROWS = [("1", "F", "old", 10.0), ("1", "F", "young", 20.0), ("1", "M", "old", 30.0), ("1", "M", "young", 40.0), ("2", "F", "old", 5.0)]


def test_share_and_totals(spark):
    got = {(r.g, r.v): (r.n, r.prop) for r in share(cells(spark, ROWS), "g", "v").collect()}
    assert got["1", 10.0] == (100.0, 0.1) and got["2", 5.0] == (5.0, 1.0)
    nulls = cells(spark, [("1", "F", "old", None), ("1", "M", "old", 4.0), ("3", "F", "old", 0.0)])
    assert {(r.g, r.sex): r.prop for r in share(nulls, "g", "v").collect()} == {("1", "F"): None, ("1", "M"): None, ("3", "F"): None}
    assert {r.sex: r.n for r in with_total(nulls.where("g = '1'"), "g", "v", na_rm=True).collect()} == {"F": 4.0, "M": 4.0}


def test_missing_groups_are_groups(spark):
    rows = [(None, "F", "old", 1.0), (None, None, "old", 3.0), ("1", None, "old", 5.0)]
    df = cells(spark, rows)
    assert {(r.g, r.v): r.prop for r in share(df, "g", "v").collect()} == {(None, 1.0): 0.25, (None, 3.0): 0.75, ("1", 5.0): 1.0}
    got = {(r.g, r.sex): (r.zip_pop, r.prop_sex, r.prop_age) for r in subset_shares(df, "g", ["sex", "age"], "v").collect()}
    assert got == {(None, "F"): (4.0, 0.25, 1.0), (None, None): (4.0, 0.75, 1.0), ("1", None): (5.0, 1.0, 1.0)}
    lattice = {(r.g, r.subset, r.sex): r.total for r in subset_totals(df, "g", ["sex"], "v").collect()}
    assert lattice == {(None, "", None): 4.0, (None, "sex", None): 3.0, (None, "sex", "F"): 1.0, ("1", "", None): 5.0, ("1", "sex", None): 5.0}


def test_share_with_one_group_holding_most_rows(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.lit(2.0).alias("v"))
    hot = share(df, "g", "v").where("g = 'hot'").agg(F.count("*").alias("n"), F.sum("prop").alias("s")).first()
    assert hot.n == 3333 and hot.s == pytest.approx(1)


def test_two_level_share(spark):
    got = {(r.g, r.sex): (r["count"], r["pop"], r.prop) for r in two_level_share(cells(spark, ROWS), "g", "sex", "v").collect()}
    assert got["1", "F"] == (30.0, 100.0, 0.3) and got["2", "F"] == (5.0, 5.0, 1.0)
    nulls = cells(spark, [("1", "F", "old", None), ("1", "M", "old", 4.0)])
    assert {r.prop for r in two_level_share(nulls, "g", "sex", "v").collect()} == {None}
    assert {r.sex: r.prop for r in two_level_share(nulls, "g", "sex", "v", na_rm=True).collect()} == {"F": None, "M": 1.0}


def test_category_share_forms_agree(spark):
    df = cells(spark, ROWS)
    forms = [["young"], "^you", lambda c: c == "young"]
    for members in forms:
        got = {r.g: r.p for r in category_share(df, "g", "age", members, "v", "p").collect()}
        assert got == {"1": pytest.approx(0.6)}  # area 2 has no such row


def test_subset_shares_against_brute_force(spark):
    random.seed(3)
    rows = [(g, s, a, float(random.randint(0, 9))) for g in "123" for s in "FM" for a in "xyz" for _ in range(random.randint(1, 3))]
    df = cells(spark, rows)

    def total(g, **dims):
        return sum(r[3] for r in rows if r[0] == g and all(r[1 if d == "sex" else 2] == x for d, x in dims.items()))

    for r in subset_shares(df, "g", ["sex", "age"], "v").collect():
        pop = total(r.g)
        assert r.zip_pop == pop
        assert r.prop_sex == pytest.approx(total(r.g, sex=r.sex) / pop)
        assert r.prop_age == pytest.approx(total(r.g, age=r.age) / pop)
        assert r.prop_sex_age == pytest.approx(total(r.g, sex=r.sex, age=r.age) / pop)
    lattice = subset_totals(df, "g", ["sex", "age"], "v").collect()
    for r in lattice:
        dims = {d: r[d] for d in r.subset.split("+") if d}
        assert (r.total, r["pop"]) == (total(r.g, **dims), total(r.g))
    sums = {}
    for r in lattice:
        sums[r.g, r.subset] = sums.get((r.g, r.subset), 0) + r.prop
    assert all(s == pytest.approx(1) for s in sums.values()) and {k[1] for k in sums} == {"", "sex", "age", "sex+age"}


def test_mean_above(spark):
    df = spark.createDataFrame([(0.6, 10.0), (0.4, 20.0), (0.9, None), (None, 6.0)], "s double, r double")
    assert tuple(mean_above(df, "r", "s", 0.5).first()) == (10.0, 12.0, 2)


# ---------------------------------------------------------------- census


def acs(spark, rows):
    """``(GEOID, variable, estimate)`` and the dictionary from ``(GEOID, code, label, estimate)``."""
    data = spark.createDataFrame([(g, c, e) for g, c, _, e in rows], "GEOID string, variable string, estimate double")
    names = spark.createDataFrame(sorted({(c, t) for _, c, t, _ in rows}), "variable string, label string")
    return data, names


def test_insurance_table(spark):
    data, names = acs(spark, [
        ("1", "B27001_001", "Estimate!!Total", 9.0), ("1", "B27001_002", "Estimate!!Total!!Male", 9.0),
        ("1", "B27001_004", "Estimate!!Total!!Male!!Under 6 years!!With health insurance coverage", 6.0),
        ("1", "B27001_005", "Estimate!!Total!!Male!!Under 6 years!!No health insurance coverage", 3.0)])
    got = {r.variable: (r.Sex, r.Age, r.HI_Coverage, r.HI_Coverage_ord) for r in acs_tidy(data, names, CENSUS_TABLES["insurance"]).collect()}
    assert got == {"B27001_004": ("Male", "Under 6 years", "Yes", 1), "B27001_005": ("Male", "Under 6 years", "No", 2)}


def test_employment_labels(spark):
    stem = "Estimate!!Total!!Male!!16 to 19 years"
    data, names = acs(spark, [
        ("1", "B23001_004", stem + "!!In labor force", 1.0), ("1", "B23001_005", stem + "!!In labor force!!Armed Forces", 1.0),
        ("1", "B23001_006", stem + "!!In labor force!!Civilian", 1.0), ("1", "B23001_007", stem + "!!In labor force!!Civilian!!Employed", 1.0),
        ("1", "B23001_008", stem + "!!In labor force!!Civilian!!Unemployed", 1.0), ("1", "B23001_009", stem + "!!Not in labor force", 1.0)])
    got = {r.variable[-1]: r.Employment for r in acs_tidy(data, names, CENSUS_TABLES["employment"]).collect()}
    assert got == {"5": "Armed Forces", "7": "Employed Civilian", "8": "Unemployed Civilian", "9": "Not in labor force"}


def test_income_ethnicity_race_gini(spark):
    data, names = acs(spark, [
        ("1", "B19101_001", "Estimate!!Total", 5.0), ("1", "B19101_002", "Estimate!!Total!!Less than $10,000", 5.0),
        ("1", "B03002_003", "Estimate!!Total!!Not Hispanic or Latino!!White alone", 2.0),
        ("1", "B03002_013", "Estimate!!Total!!Hispanic or Latino!!White alone", 1.0), ("1", "B03002_012", "Estimate!!Total!!Hispanic or Latino", 1.0),
        ("1", "B02001_002", "Estimate!!Total!!White alone", 3.0), ("1", "B19083_001", "Estimate!!Gini Index", 0.4)])
    assert [(r.variable, r.label) for r in acs_tidy(data, names, CENSUS_TABLES["income"]).collect()] == [("B19101_002", "Less than $10,000")]
    ethnic = {r.variable: (r.Hispanic_Latino, r.Race) for r in acs_tidy(data, names, CENSUS_TABLES["ethnicity"]).collect()}
    assert ethnic == {"B03002_003": ("No", "White alone"), "B03002_013": ("Yes", "White alone")}
    assert acs_tidy(data, names, CENSUS_TABLES["race"]).first().label == "White alone"
    assert acs_tidy(data, names, CENSUS_TABLES["gini"]).first().label == "Gini Index"


def test_place_names(spark):
    df = spark.createDataFrame([("Cook County, Illinois",), ("Nowhere",)], "NAME string")
    assert [(r.County, r.State) for r in split_place(df).orderBy("NAME").collect()] == [("Cook", "Illinois"), ("Nowhere", None)]


def occupation(spark):
    rows = []
    for i, zip_code in enumerate(["60601", "60602", "60603", "60604"]):
        for n, (text, e) in enumerate([("Management", 10), ("Service", 20), ("Sales", 5), ("Natural resources", 5 + 3 * i), ("Production", 4)]):
            rows.append((zip_code, f"C24060_00{n + 2}", f"Estimate!!Total!!{text} occupations", float(e)))
        rows.append((zip_code, "C24060_001", "Estimate!!Total", 99.0))
    return acs(spark, rows)


def test_city_study(spark):
    data, names = occupation(spark)
    covid = spark.createDataFrame([("60601", 100.0, 1.0), ("60602", 150.0, 4.0), ("60603", 130.0, 2.0), ("60604", 9000.0, 1.0)],
                                  "zip string, case_rate double, death_rate double")
    geos = spark.createDataFrame([("60601",), ("60602",), ("60603",), ("60604",), ("99999",)], "GEOID string")
    spec = CITY_CATEGORIES["essential"]
    shares = [(9 + 3 * i) / (44 + 3 * i) for i in range(3)]
    got = city_study(covid, data, names, geos, spec, above=3000).first()
    ys = [100, 150, 130]
    mx, my = sum(shares) / 3, sum(ys) / 3
    want = sum((a - mx) * (b - my) for a, b in zip(shares, ys)) / (
        sum((a - mx) ** 2 for a in shares) * sum((b - my) ** 2 for b in ys)) ** 0.5
    assert (got.measure, got.response, got.n, got.df) == ("prop_ess", "case_rate", 3, 1)
    assert got.r == pytest.approx(want) and 0 < got.p < 1 and got.low is None
    deaths = city_study(covid, data, names, geos, spec, response="death_rate", ids=("GEOID", ["60604"])).first()
    assert deaths.response == "death_rate" and deaths.n == 3
    two = city_report(covid, data, names, geos, {"a": spec, "b": CategorySpec("C24060", "all_of_it", ".", codes=spec.codes)})
    assert two.count() == 2


def test_every_category_has_a_usable_rule(spark):
    for spec in CITY_CATEGORIES.values():
        assert spec.members is None or isinstance(spec.members, (list, str))
        assert not (spec.codes and any(not c.startswith(spec.table + "_") for c in spec.codes))


def test_ancestry(spark):
    data, names = acs(spark, [("1", "B04006_001", "Estimate!!Total", 10.0), ("1", "B04006_002", "Estimate!!Total!!Czech", 4.0),
                              ("1", "B04006_003", "Estimate!!Total!!Danish", 6.0)])
    assert {r.label: r.prop for r in ancestry_shares(data, names).collect()} == {"Czech": 0.4, "Danish": 0.6}


def service_rows():
    """Two sexes by two industries, one missing estimate."""
    out = [("1", "C24030_003", "Estimate!!Total!!Male!!Agriculture", 10.0), ("1", "C24030_006", "Estimate!!Total!!Male!!Construction", 30.0),
           ("1", "C24030_030", "Estimate!!Total!!Female!!Agriculture", None), ("1", "C24030_033", "Estimate!!Total!!Female!!Construction", 60.0)]
    return out


def type_rows():
    stem = "Estimate!!Total!!19 to 34 years!!"
    return [("1", "B27010_019", stem + "With one type of health insurance coverage", 70.0),
            ("1", "B27010_020", stem + "With one type of health insurance coverage!!With employer-based health insurance only", 50.0),
            ("1", "B27010_023", stem + "With one type of health insurance coverage!!With Medicaid/means-tested public coverage only", 20.0),
            ("1", "B27010_033", stem + "No health insurance coverage", 30.0),
            ("2", "B27010_020", stem + "With one type of health insurance coverage!!With employer-based health insurance only", 7.0)]


def test_feature_blocks(spark):
    data, names = acs(spark, service_rows() + type_rows())
    one = feature_block(data, names, None, FEATURES["service"]).first()
    assert (one.zip_pop_work_eligible, one.prop_male_work_eligible, one.prop_service, one.prop_male_work_eligible_service) == (
        100.0, 0.4, 0.9, 0.3)
    kinds = {r.GEOID: r for r in feature_block(data, names, None, FEATURES["insurance_type"]).collect()}
    a, b = kinds["1"], kinds["2"]
    assert (a.prop_one_policy, a.prop_employer, a.prop_medicaid, a.prop_19_to_34_one_policy, a.prop_19_to_34_no_HI,
            a.prop_19_to_34_employer, a.prop_19_to_34_medicaid) == (0.7, 0.5, 0.2, 0.7, 0.3, 0.5, 0.2)
    assert (b.prop_employer, b.prop_medicaid, b.prop_19_to_34_no_HI) == (1.0, None, None)


def test_feature_master_equals_its_blocks(spark):
    data, names = acs(spark, service_rows() + type_rows())
    chosen = {k: FEATURES[k] for k in ("service", "insurance_type")}
    master = {r.GEOID: r for r in feature_master(data, names, None, chosen).collect()}
    for spec in chosen.values():
        block = feature_block(data, names, None, spec)
        for r in block.collect():
            assert all(master[r.GEOID][c] == r[c] for c in block.columns)
    assert master["2"].prop_service is None
    geos = spark.createDataFrame([("2",)], "GEOID string")
    assert [r.GEOID for r in feature_master(data, names, geos, chosen).collect()] == ["2"]


def test_missing_estimate_empties_strict_shares(spark):
    rows = service_rows()
    data, names = acs(spark, rows)
    from dataclasses import replace
    strict = feature_block(data, names, None, replace(FEATURES["service"], na_rm=False)).first()
    assert strict.zip_pop_work_eligible is None and strict.prop_service is None


def test_all_34_predictors_have_a_source():
    features = list(itertools.chain.from_iterable(c.values() for s in FEATURES.values() for c in s.pick.values()))
    totals = [s.total for s in FEATURES.values() if s.total]
    assert len(features) == len(set(features)) == 31 and totals == ["zip_pop", "zip_pop_hisp", "zip_pop_work_eligible"]


def test_published_formula(spark):
    df = spark.createDataFrame([(1000.0, 2000.0, 0.5, 0.3, 0.1, 0.8, 0.4)],
                               "zip_pop_hisp double, zip_pop_work_eligible double, prop_over_18_citizen double, prop_18_to_34_hisp double, "
                               "prop_female_19_to_34 double, prop_not_His double, prop_not_His_White double")
    want = 5.42 - 37.2 - 399.05 - 399.0 + 18.08 + 510.7 - 105.2
    assert predict_case_rate(df).first().case_rate_fit == pytest.approx(want)
