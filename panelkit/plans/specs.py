"""States, names, and which census codes make up which measure."""

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column

from panelkit.functions import code_list

# The states covered.
STATES = ["IN", "KY", "MI", "OH", "IL", "WI", "MN"]

# State names and their postal abbreviations.
STATE_NAMES = [
    ("Alabama", "AL"), ("Alaska", "AK"), ("Arizona", "AZ"), ("Arkansas", "AR"), ("California", "CA"),
    ("Colorado", "CO"), ("Connecticut", "CT"), ("Delaware", "DE"), ("Florida", "FL"), ("Georgia", "GA"),
    ("Hawaii", "HI"), ("Idaho", "ID"), ("Illinois", "IL"), ("Indiana", "IN"), ("Iowa", "IA"), ("Kansas", "KS"),
    ("Kentucky", "KY"), ("Louisiana", "LA"), ("Maine", "ME"), ("Maryland", "MD"), ("Massachusetts", "MA"),
    ("Michigan", "MI"), ("Minnesota", "MN"), ("Mississippi", "MS"), ("Missouri", "MO"), ("Montana", "MT"),
    ("Nebraska", "NE"), ("Nevada", "NV"), ("New Hampshire", "NH"), ("New Jersey", "NJ"), ("New Mexico", "NM"),
    ("New York", "NY"), ("North Carolina", "NC"), ("North Dakota", "ND"), ("Ohio", "OH"), ("Oklahoma", "OK"),
    ("Oregon", "OR"), ("Pennsylvania", "PA"), ("Rhode Island", "RI"), ("South Carolina", "SC"),
    ("South Dakota", "SD"), ("Tennessee", "TN"), ("Texas", "TX"), ("Utah", "UT"), ("Vermont", "VT"),
    ("Virginia", "VA"), ("Washington", "WA"), ("West Virginia", "WV"), ("Wisconsin", "WI"), ("Wyoming", "WY"),
]

# City markers (city, latitude, longitude).
CITY_MARKERS = [
    ("Champaign", 40.1164, -88.2434), ("Minneapolis", 44.9778, -93.2650), ("Chicago", 41.8985, -87.6341),
    ("Indianapolis", 39.7688, -86.1649), ("Detroit", 42.3410, -83.0630), ("Louisville", 38.2731, -85.7627),
    ("Milwaukee", 43.0445, -87.9109), ("Columbus", 39.9661, -83.0029),
]

# Metric, chart title, axis label.
METRICS = [
    ("cases", "Total Number of Cases", "Cases"),
    ("deaths", "Total Number of Deaths", "Deaths"),
    ("death_rate", "Number of Deaths per 100,000", "Deaths per 100,000"),
    ("case_rate", "Number of Cases per 100,000", "Cases per 100,000"),
    ("new_cases", "Number of New Cases (by day)", "Cases"),
    ("moving_7_day_avg", "Seven Day Average of New Cases", "Cases"),
    ("avg_7_day_rate", "Seven Day Average of New Cases per 100,000", "Cases per 100,000"),
]

# County names that sources spell differently.
COUNTY_SPELLING = {"Lac Qui Parle": "Lac qui Parle"}


@dataclass(frozen=True)
class TidySpec:
    """How one census table becomes tidy rows. Label rules apply to the variable dictionary."""

    table: str
    drop: Sequence[str] = ()
    codes: Sequence[str] | None = None
    depth_from: int | None = None
    depth_is: int | None = None
    reject: Sequence[str] = ()  # regular expressions on the label
    remove: Sequence[str] = ("Estimate!!Total!!",)
    rewrite: Sequence[tuple[str, str]] = ()
    into: Sequence[str] = ()  # dimension columns; empty keeps ``label``
    last: bool = False  # keep only the deepest level of the label
    flags: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)  # column: value, then, otherwise
    contains: Mapping[str, tuple[Sequence[tuple[str, str]], str]] = field(default_factory=dict)
    groups: Mapping[str, tuple[Mapping[str, Sequence[str]], str | None]] = field(default_factory=dict)
    by_code: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    fill: Mapping[str, str] = field(default_factory=dict)


# The county tables of the dashboard, with the published codes and labels.
CENSUS_TABLES = {
    "income": TidySpec("B19101", drop=["B19101_001"], remove=(), last=True),
    "insurance": TidySpec("B27001", depth_from=4, into=("Sex", "Age", "HI_Coverage"),
                          flags={"HI_Coverage": ("No health insurance coverage", "No", "Yes")}),
    "insurance_private": TidySpec("B27002", depth_from=4, into=("Sex", "Age", "Private_HI"),
                                  flags={"Private_HI": ("No private health insurance", "No", "Yes")}),
    "insurance_public": TidySpec("B27003", depth_from=4, into=("Sex", "Age", "Public_HI"),
                                 flags={"Public_HI": ("No public coverage", "No", "Yes")}),
    "race": TidySpec("B02001", depth_is=2),
    "education": TidySpec("B15001", depth_is=4, into=("Sex", "Age", "Education")),
    "employment": TidySpec("B23001", depth_from=4, reject=("!!In labor force$", "!!Civilian$"),
                           remove=("Estimate!!Total!!", "!!In labor force"),
                           rewrite=(("Civilian!!Employed", "Employed Civilian"),
                                    ("Civilian!!Unemployed", "Unemployed Civilian")),
                           into=("Sex", "Age", "Employment")),
    "ethnicity": TidySpec("B03002", depth_is=3, into=("Hispanic_Latino", "Race"),
                          flags={"Hispanic_Latino": ("Hispanic or Latino", "Yes", "No")}),
    "gini": TidySpec("B19083", remove=("Estimate!!",)),
}


@dataclass(frozen=True)
class CategorySpec:
    """One demographic of a city study: the rows that make the total and the labels that make the part."""

    table: str
    name: str
    members: Sequence[str] | str | Callable[[Column], Column] | None  # None: the estimate itself
    drop: Sequence[str] = ()
    codes: Sequence[str] | None = None
    tidy: TidySpec | None = None  # take labels from a tidy dimension instead of the last label level
    label: str = "label"


# The label groups behind the city studies.
CITY_CATEGORIES = {
    "income_high": CategorySpec("B19101", "prop_100K", [
        "$100,000 to $124,999", "$125,000 to $149,999", "$150,000 to $199,999", "$200,000 or more",
    ], drop=["B19101_001"]),
    "income_low": CategorySpec("B19101", "prop_30K", [
        "Less than $10,000", "$10,000 to $14,999", "$15,000 to $19,999", "$20,000 to $24,999", "$25,000 to $29,999",
    ], drop=["B19101_001"]),
    "poverty_below": CategorySpec("B17020", "prop_below_pov", [
        "Income in the past 12 months below poverty level"], drop=["B17020_001"]),
    "poverty_above": CategorySpec("B17020", "prop_above_pov", [
        "Income in the past 12 months at or above poverty level"], drop=["B17020_001"]),
    "essential": CategorySpec("C24060", "prop_ess", "(Natural.*)|(Production.*)", codes=code_list("C24060", range(2, 7))),
    "nonessential": CategorySpec("C24060", "prop_nonessential", [
        "Management, business, science, and arts occupations", "Service occupations",
        "Sales and office occupations", "Employee of private company workers",
    ], codes=code_list("C24060", range(2, 7))),
    "age_60": CategorySpec("B01001", "prop_60", [
        "60 and 61 years", "62 to 64 years", "65 and 66 years", "67 to 69 years", "70 to 74 years",
        "75 to 79 years", "80 to 84 years", "85 years and over",
    ], codes=code_list("B01001", range(3, 26), range(27, 50))),
    "age_65": CategorySpec("B27001", "prop_over65", ["65 to 74 years", "75 years and over"],
                           tidy=CENSUS_TABLES["insurance"], label="Age"),
    "race_black": CategorySpec("B02001", "prop_black", "^Black", codes=code_list("B02001", range(2, 9))),
    "race_asian": CategorySpec("B02001", "prop_asian", "^Asian", codes=code_list("B02001", range(2, 9))),
    "race_white": CategorySpec("B02001", "prop_white", "White alone", codes=code_list("B02001", range(2, 9))),
    "not_citizen": CategorySpec("B05001", "prop_not_citizen", ["Not a U.S. citizen"],
                                codes=code_list("B05001", range(2, 7))),
    "citizen": CategorySpec("B05001", "prop_us_citizen", "^U.S.", codes=code_list("B05001", range(2, 7))),
    "transport": CategorySpec("B08301", "prop_public", "(^Pub.*)|(Taxicab)",
                              codes=code_list("B08301", 2, 10, range(16, 22))),
    "gini": CategorySpec("B19083", "gini", None),
    "insured": CategorySpec("B27001", "prop_insured", ["Yes"], tidy=CENSUS_TABLES["insurance"], label="HI_Coverage"),
    "insured_private": CategorySpec("B27002", "prop_private", ["Yes"], tidy=CENSUS_TABLES["insurance_private"],
                                    label="Private_HI"),
    "insured_public": CategorySpec("B27003", "prop_public_HI", ["Yes"], tidy=CENSUS_TABLES["insurance_public"],
                                   label="Public_HI"),
    "insured_private_older": CategorySpec("B18135", "prop_priv", ["With private health insurance coverage"],
                                          drop=["B18135_023"]),
    "public_assistance": CategorySpec("B19058", "prop_assistance", "^With.*", drop=["B19058_001"]),
}


# The ancestry table.
ANCESTRY = TidySpec("B04006", drop=["B04006_001"], remove=(), last=True)


@dataclass(frozen=True)
class FeatureSpec:
    """One block of the feature master: subset shares of a tidy table, read at representative codes."""

    tidy: TidySpec
    dims: Sequence[str]
    pick: Mapping[str, Mapping[str, str]]  # code: {share column: feature}
    total: str | None = None  # name of the population column, if kept
    na_rm: bool = False


# Published age labels.
_MINOR = ["Under 5 years", "5 to 9 years", "10 to 14 years", "15 to 17 years"]

# The blocks of the 34-predictor table, with the feature names of its dictionary.
FEATURES = {
    "citizenship": FeatureSpec(
        TidySpec("B05003", drop=["B05003_001"], depth_from=4, reject=("Foreign born$",),
                 remove=("Estimate!!Total!!", "Foreign born!!"), into=("Sex", "Age", "Citizen"),
                 flags={"Citizen": ("Not a U.S. citizen", "No", "Yes")}),
        ("Sex", "Age", "Citizen"),
        {"B05003_020": {
            "prop_Age": "prop_over_18", "prop_Citizen": "prop_citizen", "prop_Sex_Age": "prop_female_over_18",
            "prop_Sex_Citizen": "prop_female_citizen", "prop_Age_Citizen": "prop_over_18_citizen",
            "prop_Sex_Age_Citizen": "prop_female_over_18_citizen"}},
        total="zip_pop"),
    "hispanic_age": FeatureSpec(
        TidySpec("B01001I", drop=code_list("B01001I", 1, 2, 17), into=("Sex", "Age"),
                 groups={"Age": ({
                     "0-17 years": _MINOR,
                     "18-34 years": ["18 and 19 years", "20 to 24 years", "25 to 29 years", "30 to 34 years"],
                     "35-64 years": ["35 to 44 years", "45 to 54 years", "55 to 64 years"]}, "65+")}),
        ("Sex", "Age"),
        {"B01001I_022": {"prop_Sex": "prop_female_hisp", "prop_Age": "prop_18_to_34_hisp",
                         "prop_Sex_Age": "prop_female_18_to_34_hisp"}},
        total="zip_pop_hisp"),
    "insurance": FeatureSpec(
        TidySpec("B27001", depth_from=4, into=("Sex", "Age", "HI"),
                 flags={"HI": ("With health insurance coverage", "Yes", "No")},
                 groups={"Age": ({
                     "0-18 years": ["Under 6 years", "6 to 18 years"],
                     "19-34 years": ["19 to 25 years", "26 to 34 years"],
                     "35-64 years": ["35 to 44 years", "45 to 54 years", "55 to 64 years"]}, "65+")}),
        ("Sex", "Age", "HI"),
        {"B27001_038": {
            "prop_Age": "prop_19_to_34", "prop_HI": "prop_with_HI", "prop_Sex_Age": "prop_female_19_to_34",
            "prop_Sex_HI": "prop_female_with_HI", "prop_Age_HI": "prop_19_to_34_with_HI",
            "prop_Sex_Age_HI": "prop_female_19_to_34_with_HI"}}),
    "race": FeatureSpec(
        TidySpec("B03002", codes=code_list("B03002", range(3, 10), range(13, 20)), into=("Hispanic", "Race"),
                 flags={"Hispanic": ("Not Hispanic or Latino", "No", "Yes")},
                 groups={"Race": ({
                     "White": ["White alone"], "Black": ["Black or African American alone"],
                     "AIAN": ["American Indian and Alaska Native alone"], "Asian": ["Asian alone"],
                     "NHPI": ["Native Hawaiian and Other Pacific Islander alone"],
                     "Other": ["Some other race alone"]}, "Two or more")}),
        ("Hispanic", "Race"),
        {"B03002_003": {"prop_Hispanic": "prop_not_His", "prop_Race": "prop_White",
                        "prop_Hispanic_Race": "prop_not_His_White"}}),
    "service": FeatureSpec(
        TidySpec("C24030",
                 codes=code_list("C24030", 3, range(6, 11), 13, 14, 17, 21, range(25, 29), 30, range(33, 38), 40, 41,
                                 44, 48, range(52, 56)),
                 remove=("Estimate!!Total!!",
                         "Arts, entertainment, and recreation, and accommodation and food services!!"),
                 into=("Sex", "Service"),
                 groups={"Service": ({"Yes": [
                     "Construction", "Manufacturing", "Retail trade", "Transportation and warehousing, and utilities",
                     "Accommodation and food services"]}, "No")}),
        ("Sex", "Service"),
        {"C24030_006": {"prop_Sex": "prop_male_work_eligible", "prop_Service": "prop_service",
                        "prop_Sex_Service": "prop_male_work_eligible_service"}},
        total="zip_pop_work_eligible", na_rm=True),
    "sex_age": FeatureSpec(
        TidySpec("B01001", depth_is=3, into=("Sex", "Age_Group"),
                 by_code={"Age_Group": {
                     "Under 5 to 17": code_list("B01001", range(3, 7), range(27, 31)),
                     "18 to 34": code_list("B01001", range(7, 13), range(31, 37)),
                     "35 to 64": code_list("B01001", range(13, 20), range(37, 44)),
                     "65 and Older": code_list("B01001", range(20, 26), range(44, 50))}}),
        ("Sex", "Age_Group"),
        {"B01001_031": {"prop_Sex": "prop_female", "prop_Age_Group": "prop_18_to_34",
                        "prop_Sex_Age_Group": "prop_female_18_to_34"}}),
    "insurance_type": FeatureSpec(
        TidySpec("B27010", depth_from=3, reject=("of health insurance coverage$",), into=("Age", "Policies", "Type"),
                 contains={"Policies": ((("With one", "One"), ("With two", "Two or more")), "None")},
                 fill={"Type": "None"}),
        ("Age", "Policies", "Type"),
        {"B27010_020": {"prop_Policies": "prop_one_policy", "prop_Type": "prop_employer",
                        "prop_Age_Policies": "prop_19_to_34_one_policy", "prop_Age_Type": "prop_19_to_34_employer"},
         "B27010_023": {"prop_Type": "prop_medicaid", "prop_Age_Type": "prop_19_to_34_medicaid"},
         "B27010_033": {"prop_Age_Policies": "prop_19_to_34_no_HI"}}),
}

# The published formula for the case rate.
CASE_RATE_FORMULA = {
    "zip_pop_hisp": 0.00542, "zip_pop_work_eligible": -0.0186, "prop_over_18_citizen": -798.1,
    "prop_18_to_34_hisp": -1330.0, "prop_female_19_to_34": 180.8, "prop_hisp": 2553.5,
    "prop_not_His_White": -263.0,
}
