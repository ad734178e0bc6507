"""The shipped census specifications, over rows derived from the given lines.

Every published code of a table gets an estimate: a line falls on one leaf of each table, and the codes above a leaf are the sums
of theirs, as they are published. Codes follow from the labels: a table's tree is numbered from the top, depth first.
"""

from pyspark.sql import DataFrame, functions as F

from panelkit.plans import acs_tidy, feature_master
from panelkit.plans.specs import CENSUS_TABLES, FEATURES
from panelkit.queries.inputs import parts
from panelkit.queries.registry import query, rounded, Tables
from panelkit.sources import lookup

# Published labels, level by level.
SEX = ["Male", "Female"]
INSURED_AGES = ["Under 6 years", "6 to 18 years", "19 to 25 years", "26 to 34 years", "35 to 44 years", "45 to 54 years", "55 to 64 years",
                "65 to 74 years", "75 years and over"]
INCOME = ["Less than $10,000", "$10,000 to $14,999", "$15,000 to $19,999", "$20,000 to $24,999", "$25,000 to $29,999", "$30,000 to $34,999",
          "$35,000 to $39,999", "$40,000 to $44,999", "$45,000 to $49,999", "$50,000 to $59,999", "$60,000 to $74,999", "$75,000 to $99,999",
          "$100,000 to $124,999", "$125,000 to $149,999", "$150,000 to $199,999", "$200,000 or more"]
RACES = ["White alone", "Black or African American alone", "American Indian and Alaska Native alone", "Asian alone",
         "Native Hawaiian and Other Pacific Islander alone", "Some other race alone",
         ("Two or more races", ["Two races including Some other race", "Two races excluding Some other race, and three or more races"])]
SCHOOLS = ["Less than 9th grade", "9th to 12th grade, no diploma", "High school graduate (includes equivalency)", "Some college, no degree",
           "Associate's degree", "Bachelor's degree", "Graduate or professional degree"]
WORKING_AGES = ["16 to 19 years", "20 and 21 years", "22 to 24 years", "25 to 29 years", "30 to 34 years", "35 to 44 years", "45 to 54 years",
                "55 to 59 years", "60 and 61 years", "62 to 64 years"]
WORK = [("In labor force", ["In Armed Forces", ("Civilian", ["Employed", "Unemployed"])]), "Not in labor force"]
LATE_WORK = [("In labor force", ["Employed", "Unemployed"]), "Not in labor force"]
BIRTH = ["Native", ("Foreign born", ["Naturalized U.S. citizen", "Not a U.S. citizen"])]
HISPANIC_AGES = ["Under 5 years", "5 to 9 years", "10 to 14 years", "15 to 17 years", "18 and 19 years", "20 to 24 years", "25 to 29 years",
                 "30 to 34 years", "35 to 44 years", "45 to 54 years", "55 to 64 years", "65 to 74 years", "75 to 84 years", "85 years and over"]
AGES = ["Under 5 years", "5 to 9 years", "10 to 14 years", "15 to 17 years", "18 and 19 years", "20 years", "21 years", "22 to 24 years",
        "25 to 29 years", "30 to 34 years", "35 to 39 years", "40 to 44 years", "45 to 49 years", "50 to 54 years", "55 to 59 years",
        "60 and 61 years", "62 to 64 years", "65 and 66 years", "67 to 69 years", "70 to 74 years", "75 to 79 years", "80 to 84 years", "85 years and over"]
INDUSTRIES = [
    ("Agriculture, forestry, fishing and hunting, and mining", ["Agriculture, forestry, fishing and hunting", "Mining, quarrying, and oil and gas extraction"]),
    "Construction", "Manufacturing", "Wholesale trade", "Retail trade",
    ("Transportation and warehousing, and utilities", ["Transportation and warehousing", "Utilities"]), "Information",
    ("Finance and insurance, and real estate, and rental and leasing", ["Finance and insurance", "Real estate and rental and leasing"]),
    ("Professional, scientific, and management, and administrative, and waste management services", [
        "Professional, scientific, and technical services", "Management of companies and enterprises", "Administrative and support and waste management services"]),
    ("Educational services, and health care and social assistance", ["Educational services", "Health care and social assistance"]),
    ("Arts, entertainment, and recreation, and accommodation and food services", ["Arts, entertainment, and recreation", "Accommodation and food services"]),
    "Other services, except public administration", "Public administration"]
POLICIES = [
    ("With one type of health insurance coverage", [
        "With employer-based health insurance only", "With direct-purchase health insurance only", "With Medicare coverage only",
        "With Medicaid/means-tested public coverage only", "With TRICARE/military health coverage only", "With VA Health Care only"]),
    ("With two or more types of health insurance coverage", [
        "With employer-based and direct-purchase coverage", "With employer-based and Medicare coverage", "With Medicare and Medicaid/means-tested public coverage",
        "Other private only combinations", "Other public only combinations", "Other coverage combinations"]),
    "No health insurance coverage"]


def _each(names: list[str], below: list) -> list:
    return [(name, below) for name in names]


TREES = {
    "B19101": INCOME, "B02001": RACES, "B03002": _each(["Not Hispanic or Latino", "Hispanic or Latino"], RACES),
    "B27001": _each(SEX, _each(INSURED_AGES, ["With health insurance coverage", "No health insurance coverage"])),
    "B27002": _each(SEX, _each(INSURED_AGES, ["With private health insurance", "No private health insurance"])),
    "B27003": _each(SEX, _each(INSURED_AGES, ["With public coverage", "No public coverage"])),
    "B15001": _each(SEX, _each(["18 to 24 years", "25 to 34 years", "35 to 44 years", "45 to 64 years", "65 years and over"], SCHOOLS)),
    "B23001": _each(SEX, [*_each(WORKING_AGES, WORK), *_each(["65 to 69 years", "70 to 74 years", "75 years and over"], LATE_WORK)]),
    "B05003": _each(SEX, _each(["Under 18 years", "18 years and over"], BIRTH)), "B01001I": _each(SEX, HISPANIC_AGES), "B01001": _each(SEX, AGES),
    "C24030": _each(SEX, INDUSTRIES), "B27010": _each(["Under 19 years", "19 to 34 years", "35 to 64 years", "65 years and over"], POLICIES)}


def _numbered(names: list, above: tuple[str, ...]) -> list[tuple[str, ...]]:
    out = []
    for one in names:
        name, below = one if isinstance(one, tuple) else (one, [])
        out += [(*above, name), *_numbered(below, (*above, name))]
    return out


def labels() -> list[tuple[str, str]]:
    """``(variable, label)`` of every code of every table."""
    out = [("B19083_001", "Estimate!!Gini Index")]
    for table, tree in TREES.items():
        paths = [("Estimate", "Total"), *_numbered(tree, ("Estimate", "Total"))]
        out += [(f"{table}_{i:03d}", "!!".join(path)) for i, path in enumerate(paths, 1)]
    return out


def _leaves() -> list[tuple[str, int, int, str]]:
    """``(table, its leaves, number of the leaf, code of the leaf or of one above it)``."""
    out = []
    for table in [*TREES, "B19083"]:
        own = [(v, text) for v, text in labels() if v.startswith(f"{table}_")]
        ends = [(v, text) for v, text in own if not any(other.startswith(f"{text}!!") for _, other in own)]
        out += [(table, len(ends), i, v) for i, (_, leaf) in enumerate(ends) for v, text in own if f"{leaf}!!".startswith(f"{text}!!")]
    return out


def dictionary(t: Tables) -> DataFrame:
    return lookup(t.spark, labels(), "variable string, label string")


def estimates(t: Tables) -> DataFrame:
    """``(GEOID, variable, estimate)``: lines per supplier, each on one leaf of every table.

    Lines are dealt to as many partitions as they need, by supplier and spot; the sums move to their supplier, at most 5,040 to each,
    and its leaves and codes are formed there.
    """
    n = parts(t.lineitem)
    lines = t.lineitem.select(F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("GEOID"),
                              F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(5040)).alias("spot"), "l_quantity")
    spots = lines.repartition(n, "GEOID", "spot").groupBy("GEOID", "spot").agg(F.sum("l_quantity").alias("q")).repartition(n, "GEOID")
    leaves = lookup(t.spark, _leaves(), "table string, many int, leaf int, variable string").drop("many")
    tables = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(many).alias("many")) for table, many in sorted({x[:2] for x in _leaves()})])
    on_leaf = spots.select("*", F.inline(tables)).withColumn("leaf", F.pmod("spot", "many").cast("int")).groupBy("GEOID", "table", "leaf").agg(F.sum("q").alias("q"))
    return on_leaf.join(F.broadcast(leaves), ["table", "leaf"]).groupBy("GEOID", "variable").agg(F.sum("q").cast("double").alias("estimate"))


# ---------------------------------------------------------------- the same in SQL

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BASE_SQL = f"""dict AS (SELECT variable, label, string_split(variable, '_')[1] AS tab, string_split(label, '!!') AS w
  FROM (VALUES {", ".join(f"({_quoted(v)}, {_quoted(x)})" for v, x in labels())}) AS v(variable, label)),
ends AS (SELECT tab, label, row_number() OVER (PARTITION BY tab ORDER BY variable) - 1 AS leaf, count(*) OVER (PARTITION BY tab) AS many
  FROM dict a WHERE NOT EXISTS (FROM dict b WHERE b.tab = a.tab AND starts_with(b.label, a.label || '!!'))),
spots AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS GEOID, (l_partkey * 7 + l_linenumber) % 5040 AS spot, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
acs AS (SELECT GEOID, d.variable, any_value(d.tab) AS tab, any_value(d.label) AS label, any_value(d.w) AS w, CAST(sum(q) AS DOUBLE) AS estimate
  FROM spots JOIN ends ON spot % many = leaf JOIN dict d ON d.tab = ends.tab AND starts_with(ends.label || '!!', d.label || '!!') GROUP BY 1, 2)"""


def _tidy_sql(table: str, dims: dict[str, str], where: str) -> str:
    """``dims``: names and expressions over the label's parts ``w``; each gets its order of first appearance among the codes."""
    named = ", ".join(f'{e} AS "{n}"' for n, e in dims.items())
    firsts = ", ".join(f'min(variable) OVER (PARTITION BY "{n}") AS "{n}_first"' for n in dims)
    ranks = ", ".join(f'dense_rank() OVER (ORDER BY "{n}_first") AS "{n}_ord"' for n in dims)
    shown = ", ".join(f'"{n}", CAST("{n}_ord" AS INT) AS "{n}_ord"' for n in dims)
    return f"""WITH {BASE_SQL}, codes AS (SELECT variable, {named} FROM dict WHERE tab = '{table}' AND {where}),
ranked AS (SELECT *, {ranks} FROM (SELECT *, {firsts} FROM codes))
SELECT GEOID, variable, {shown}, estimate FROM (SELECT GEOID, variable, estimate FROM acs) JOIN ranked USING (variable)"""


_COVER = "CASE WHEN starts_with(w[5], 'No ') THEN 'No' ELSE 'Yes' END"
TIDY = {
    "income": ("B19101", {"label": "w[3]"}, "len(w) = 3"), "race": ("B02001", {"label": "w[3]"}, "len(w) = 3"), "gini": ("B19083", {"label": "w[2]"}, "true"),
    "insurance": ("B27001", {"Sex": "w[3]", "Age": "w[4]", "HI_Coverage": _COVER}, "len(w) = 5"),
    "insurance_private": ("B27002", {"Sex": "w[3]", "Age": "w[4]", "Private_HI": _COVER}, "len(w) = 5"),
    "insurance_public": ("B27003", {"Sex": "w[3]", "Age": "w[4]", "Public_HI": _COVER}, "len(w) = 5"),
    "education": ("B15001", {"Sex": "w[3]", "Age": "w[4]", "Education": "w[5]"}, "len(w) = 5"),
    "ethnicity": ("B03002", {"Hispanic_Latino": "CASE WHEN w[3] = 'Hispanic or Latino' THEN 'Yes' ELSE 'No' END", "Race": "w[4]"}, "len(w) = 4"),
    "employment": ("B23001", {"Sex": "w[3]", "Age": "w[4]", "Employment": "CASE WHEN w[6] = 'Civilian' THEN w[7] || ' Civilian' ELSE coalesce(w[6], w[5]) END"},
                   "len(w) >= 5 AND w[-1] NOT IN ('In labor force', 'Civilian')")}

for _name, _twin in TIDY.items():
    @query(f"tidy_{_name}", _tidy_sql(*_twin))
    def _tidied(t: Tables, name: str = _name) -> DataFrame:
        return acs_tidy(estimates(t), dictionary(t), CENSUS_TABLES[name])


def _block_sql(name: str, table: str, dims: dict[str, str], where: str, chosen: dict[str, dict[str, str]]) -> str:
    """One block: sums over its codes; ``chosen`` gives the values of the dimensions at each representative code."""
    parts = [f"sum(estimate) AS {name}_all"]
    shown = []
    for code, values in chosen.items():
        for column, feature in FEATURES[name].pick[code].items():
            used = [d for d in dims if f"_{d}_" in f"{column}_"]
            hit = " AND ".join(f'"{d}" = {_quoted(values[d])}' for d in used)
            parts.append(f"CASE WHEN bool_or(variable = '{code}') THEN sum(CASE WHEN {hit} THEN estimate END) / sum(estimate) END AS {feature}")
            shown.append(feature)
        parts.append(f"bool_or(variable = '{code}') AS has_{code}")
    if FEATURES[name].total:
        parts.append(f"CASE WHEN bool_or(variable = '{next(iter(chosen))}') THEN sum(estimate) END AS {FEATURES[name].total}")
    named = ", ".join(f'{e} AS "{d}"' for d, e in dims.items())
    return f"""{name} AS (SELECT GEOID, {", ".join(parts)} FROM (SELECT *, {named} FROM acs WHERE tab = '{table}' AND {where}) GROUP BY 1)"""


MASTER = {
    "citizenship": ("B05003", {"Sex": "w[3]", "Age": "w[4]", "Citizen": "CASE WHEN w[-1] = 'Not a U.S. citizen' THEN 'No' ELSE 'Yes' END"},
                    "len(w) >= 5 AND w[-1] <> 'Foreign born'", {"B05003_020": {"Sex": "Female", "Age": "18 years and over", "Citizen": "Yes"}}),
    "hispanic_age": ("B01001I", {"Sex": "w[3]", "Age": "CASE WHEN w[4] IN ('18 and 19 years', '20 to 24 years', '25 to 29 years', '30 to 34 years') THEN 'young' ELSE w[4] END"},
                     "len(w) = 4", {"B01001I_022": {"Sex": "Female", "Age": "young"}}),
    "insurance": ("B27001", {"Sex": "w[3]", "Age": "CASE WHEN w[4] IN ('19 to 25 years', '26 to 34 years') THEN 'young' ELSE w[4] END", "HI": _COVER},
                  "len(w) = 5", {"B27001_038": {"Sex": "Female", "Age": "young", "HI": "Yes"}}),
    "race": ("B03002", {"Hispanic": "CASE WHEN w[3] = 'Not Hispanic or Latino' THEN 'No' ELSE 'Yes' END", "Race": "w[4]"}, "len(w) = 4",
             {"B03002_003": {"Hispanic": "No", "Race": "White alone"}}),
    "service": ("C24030", {"Sex": "w[3]", "Service": "CASE WHEN w[-1] IN ('Construction', 'Manufacturing', 'Retail trade', 'Transportation and warehousing, and utilities', 'Accommodation and food services') THEN 'Yes' ELSE 'No' END"},
                "((len(w) = 4 AND NOT starts_with(w[4], 'Arts')) OR (len(w) = 5 AND starts_with(w[4], 'Arts')))",
                {"C24030_006": {"Sex": "Male", "Service": "Yes"}}),
    "sex_age": ("B01001", {"Sex": "w[3]", "Age_Group": "CASE WHEN w[4] IN ('18 and 19 years', '20 years', '21 years', '22 to 24 years', '25 to 29 years', '30 to 34 years') THEN 'young' ELSE 'not' END"},
                "len(w) = 4", {"B01001_031": {"Sex": "Female", "Age_Group": "young"}}),
    "insurance_type": ("B27010", {"Age": "w[3]", "Policies": "CASE WHEN contains(w[4], 'With one') THEN 'One' WHEN contains(w[4], 'With two') THEN 'Two' ELSE 'None' END",
                                  "Type": "coalesce(w[5], 'None')"}, "(len(w) = 5 OR w[4] = 'No health insurance coverage')",
                       {"B27010_020": {"Age": "19 to 34 years", "Policies": "One", "Type": "With employer-based health insurance only"},
                        "B27010_023": {"Age": "19 to 34 years", "Policies": "One", "Type": "With Medicaid/means-tested public coverage only"},
                        "B27010_033": {"Age": "19 to 34 years", "Policies": "None", "Type": "None"}})}


def _master_sql() -> str:
    blocks = [_block_sql(name, *parts) for name, parts in MASTER.items()]
    totals = [FEATURES[n].total for n in MASTER if FEATURES[n].total]
    features = [f for n in MASTER for pick in FEATURES[n].pick.values() for f in pick.values()]
    has = [f"coalesce(has_{code}, false)" for n in MASTER for code in FEATURES[n].pick]
    return (f"WITH {BASE_SQL}, " + ", ".join(blocks) + ", areas AS (SELECT DISTINCT GEOID FROM acs) SELECT GEOID, "
            + ", ".join([*totals, *[f"round({f}, 6) AS {f}" for f in features]]) + " FROM areas "
            + " ".join(f"LEFT JOIN {n} USING (GEOID)" for n in MASTER) + f" WHERE {' OR '.join(has)}")


@query("published_feature_master", _master_sql())
def published_feature_master(t: Tables) -> DataFrame:
    """All predictors of the published table."""
    return rounded(feature_master(estimates(t), dictionary(t)))
