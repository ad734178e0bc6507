"""The newest column of each wide file, side by side."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelkit.functions import clean_number
from panelkit.operators import latest_column, snapshot_rates
from panelkit.plans.specs import STATE_NAMES, STATES
from panelkit.sources.tables import lookup

KEYS = ["NAME", "County", "State", "State_abb"]


def _part(df: DataFrame, name: str, states: Sequence[str] | None, names: DataFrame) -> DataFrame:
    part = latest_column(df, ["County Name", "State"], name)
    if states is not None:
        part = part.where(F.col("State").isin(list(states)))
    if dict(part.dtypes)[name] == "string":
        part = part.withColumn(name, clean_number(name))
    full = names.select(F.col("State").alias("_full"), F.col("Abb").alias("State"))
    return part.join(full, "State", "left").select(
        F.concat("County Name", F.lit(", "), "_full").alias("NAME"), F.col("County Name").alias("County"),
        F.col("_full").alias("State"), F.col("State").alias("State_abb"), F.col(name).cast("double").alias(name))


def build_snapshot(cases: DataFrame, deaths: DataFrame, pop: DataFrame, states: Sequence[str] | None = STATES,
                   names: DataFrame | None = None) -> DataFrame:
    """``(NAME, County, State, State_abb, Cases, Deaths, Population, case_fatality, death_rate, case_rate)``."""
    if names is None:
        names = lookup(cases.sparkSession, STATE_NAMES, "State string, Abb string")
    joined = (_part(cases, "Cases", states, names)
              .join(_part(deaths, "Deaths", states, names), KEYS, "left")
              .join(_part(pop, "Population", states, names), KEYS, "left"))
    return snapshot_rates(joined)
