"""The published rates."""

from pyspark.sql import DataFrame, functions as F

from panelkit.functions import half_even, per_capita, ratio


def snapshot_rates(df: DataFrame, per: float = 100000, digits: int | None = 3) -> DataFrame:
    """Add case_fatality (percent), death_rate and case_rate to a table of Cases, Deaths, Population."""
    rates = {
        "case_fatality": ratio("Deaths", "Cases") * 100,
        "death_rate": per_capita("Deaths", "Population", per),
        "case_rate": per_capita("Cases", "Population", per),
    }
    if digits is not None:
        rates = {n: half_even(c, digits) for n, c in rates.items()}
    return df.withColumns(rates)


def panel_rates(df: DataFrame, per: float = 100000) -> DataFrame:
    """Add the cumulative case and death rate of each day."""
    return df.withColumns({"case_rate": per_capita("cases", "population", per),
                           "death_rate": per_capita("deaths", "population", per)})


def rolling_rate(df: DataFrame, per: float = 100000, days: int = 1, name: str = "avg_7_day_rate") -> DataFrame:
    """Rolling mean per capita; ``days=7`` gives the weekly-sum form."""
    return df.withColumn(name, per_capita(F.col("moving_7_day_avg") * days, "population", per))


def positivity(df: DataFrame, cases: str = "Cases", tested: str = "Tested", name: str = "pos_rate") -> DataFrame:
    return df.withColumn(name, ratio(cases, tested))
