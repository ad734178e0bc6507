"""Wide daily files to the county panel."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelkit.functions import canonical, clean_number
from panelkit.operators import (
    cols_like, daily_new, pack_dates, panel_rates, rolling_rate, split_unallocated, unpack_dates,
)
from panelkit.plans.specs import COUNTY_SPELLING, STATE_NAMES, STATES
from panelkit.sources.tables import lookup

IDS = ["county_name", "state"]


def _wide(df: DataFrame, states: Sequence[str] | None) -> DataFrame:
    """Agreed id names, no FIPS columns, only the wanted states: before anything gets long."""
    df = df.withColumnsRenamed({"County Name": "county_name", "State": "state"}).drop(*cols_like(df, suffix="FIPS"))
    return df if states is None else df.where(F.col("state").isin(list(states)))


def _packed(df: DataFrame, states: Sequence[str] | None, value: str, dates: Sequence[str] | None = None) -> DataFrame:
    """One row per county with its counts, text as a rule, as an array."""
    wide = _wide(df, states)
    return pack_dates(wide, IDS, value, dates).withColumn("county_name", canonical("county_name", COUNTY_SPELLING))


def packed_counties(cases: DataFrame, deaths: DataFrame, pop: DataFrame, states: Sequence[str] | None = STATES,
                    include_unallocated: bool = False, names: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Counties as one row each, with their counts in arrays along the dates, population and state name; and the dates."""
    wide = _wide(cases, states)
    dates = [c for c in wide.columns if c not in IDS]
    counts = _packed(cases, states, "cases", dates)
    if not include_unallocated:
        counts, _ = split_unallocated(counts)
    people = _wide(pop, states).select(
        canonical("county_name", COUNTY_SPELLING).alias("county_name"), "state", F.col("population").cast("double"))
    if names is None:
        names = lookup(pop.sparkSession, STATE_NAMES, "State string, Abb string")
    full = names.select(F.col("State").alias("state_name"), F.col("Abb").alias("state"))
    counties = (counts.join(full, "state", "left").repartition(*IDS)
                .join(_packed(deaths, states, "deaths", dates), IDS, "left").join(people, IDS, "left"))
    return counties, dates


def panel_days(long: DataFrame, clamp: str = "after") -> DataFrame:
    """Rates, daily changes and rolling means of days ``(ids, state_name, population, date, cases, deaths)``."""
    kinds = dict(long.dtypes)
    long = long.withColumns({c: clean_number(c) if kinds[c] == "string" else F.col(c).cast("double")
                             for c in ("cases", "deaths")})
    panel = rolling_rate(daily_new(panel_rates(long), IDS, "date", "cases", clamp))
    return panel.withColumns({
        "NAME": F.concat("county_name", F.lit(", "), "state_name"),
        "name_short": F.concat("county_name", F.lit(", "), "state"),
    }).select(*IDS, "date", "cases", "deaths", "population", "case_rate", "death_rate", "new_cases",
              "moving_7_day_avg", "avg_7_day_rate", "NAME", "name_short")


def build_panel(cases: DataFrame, deaths: DataFrame, pop: DataFrame, states: Sequence[str] | None = STATES,
                clamp: str = "after", include_unallocated: bool = False, names: DataFrame | None = None,
                date_fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Rates, daily changes and rolling means per county and day from three wide tables.

    Input ids are ``County Name`` and ``State`` (or already ``county_name``, ``state``), one row per county.
    ``names`` maps state name to abbreviation (columns ``State``, ``Abb``); the built-in list is the default.

    Counties are shuffled and joined while each is one row; only then do they become one row per day. The
    long rows are born in the partition where the windows need them and are never shuffled.
    """
    counties, dates = packed_counties(cases, deaths, pop, states, include_unallocated, names)
    return panel_days(unpack_dates(counties, ["cases", "deaths"], dates, date_fmt), clamp)
