"""Tables behind the map, the comparison chart and the published bulletins."""

from collections.abc import Mapping, Sequence
import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelkit.functions import (
    extract_or_null, half_even, long_date, number_text, parse_us_date, short_date, sum_strict, sunday_week,
)
from panelkit.operators import (
    at_date, at_latest, join_lines, ordered_levels, split_unallocated, spread, two_level_share, weekly_totals,
)
from panelkit.plans.specs import METRICS
from panelkit.session import settle

# The published wordings.
NOT_REPORTED = "Not Reported"
NO_LONGER = "No longer reporting"
NO_UPDATE_DAILY = "No updated data from usafacts.org today. Check back tomorrow."
NO_UPDATE_WEEKLY = ("No updated data from https://usafacts.org/visualizations/coronavirus-covid-19-spread-map "
                    "this week. Check back next week.")
HEADING = "COVID in "
POPUP = (("Cases", "cases", 0), ("Deaths", "deaths", 0), ("Case Rate", "case_rate", 2), ("Death Rate", "death_rate", 2),
         ("New Cases", "new_cases", 0), ("7 Day Average", "moving_7_day_avg", 2), ("7 Day Avg Rate", "avg_7_day_rate", 2))
POST_PATTERN = r"by State for (\p{L}+ \d{2}, \d{4}) \("


def popup(c_date: str = "date") -> Column:
    """The text shown when a county is touched."""
    parts = [F.lit("<strong>"), F.col("county_name"), F.lit(", "), F.col("state"), F.lit("</strong><br /><strong>"),
             short_date(c_date), F.lit("</strong>")]
    for title, column, digits in POPUP:
        parts += [F.lit(f"<br /> {title}: "), number_text(column, digits)]
    return F.concat(*parts)


def map_layer(panel: DataFrame, metric: str, d: dt.date | str, low: float = 0.001) -> DataFrame:
    """Counties at one date: the metric, the popup text, and the place of the metric in the colour range.

    The range runs from ``low`` to the largest value of the metric on any date, plus one.
    """
    top = panel.agg(F.max(metric) + 1).scalar()
    rows = at_date(panel, "date", d)
    return rows.select("county_name", "state", "date", F.col(metric).alias("value"), popup().alias("popup"),
                       ((F.col(metric) - low) / (top - low)).alias("position"))


def compare(panel: DataFrame, names: Sequence[str], metric: str, name: str = "NAME") -> DataFrame:
    """Series of the chosen counties for one metric, with heading, chart title and axis label.

    The heading names one or two counties (or more) in the order in which they were chosen.
    """
    titles = {m: (t, a) for m, t, a in METRICS}
    title, axis = titles.get(metric, titles["cases"])
    return panel.where(F.col(name).isin(list(names))).select(
        F.col(name).alias("name"), "date", F.col(metric).alias("value"),
        F.lit(comparison_heading(names)).alias("heading"), F.lit(title).alias("title"), F.lit(axis).alias("axis"))


def comparison_heading(names: Sequence[str]) -> str:
    """``COVID in A, XX and B, YY``."""
    return HEADING + " and ".join(n for n in names if n)


def _reported(total: Column) -> Column:
    return F.when(total == 0, F.lit(NOT_REPORTED)).otherwise(number_text(total, 0))


def daily_bulletin(panel: DataFrame) -> DataFrame:
    """One row: the newest date and the text with one line per state."""
    newest = at_latest(panel)
    states = newest.groupBy("date", "state").agg(
        sum_strict("new_cases").alias("total"), half_even(sum_strict("moving_7_day_avg")).alias("mean"))
    line = F.concat("state", F.lit(": "), _reported(F.col("total")), F.lit(" ("), number_text("mean", 0), F.lit(")"))
    intro = F.concat(F.lit("Daily Newly Reported Cases by State for "), long_date("date"),
                     F.lit(" (7-day Moving Average in Parentheses)\n\n"))
    return (join_lines(states, ["date"], line, "state", "lines")
            .select("date", F.concat(intro, F.col("lines")).alias("text")))


def publish_gate(panel: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The daily text if the newest date is the day before ``as_of``, else the no-update text."""
    fresh = F.col("date") == F.date_sub(F.lit(as_of).cast("date"), 1)
    return daily_bulletin(panel).select(
        "date", fresh.alias("fresh"), F.when(fresh, F.col("text")).otherwise(F.lit(NO_UPDATE_DAILY)).alias("text"))


def last_published_week(posts: DataFrame, text: str = "text") -> DataFrame:
    """One row ``mark``: the Sunday week of the newest bulletin among earlier posts."""
    dated = posts.where(F.col(text).rlike("^((Daily)|(New))"))
    day = parse_us_date(extract_or_null(text, POST_PATTERN), "MMMM dd, yyyy")
    return dated.agg(sunday_week(F.max(day)).alias("mark"))


def weekly_bulletins(panel: DataFrame, posts: DataFrame) -> DataFrame:
    """Texts for the weeks that follow the newest post: ``(week, text)``.

    The weekly sums, some rows per week, are written once, because the stop rule and the texts both read them.
    A week in which every state is at zero stops the series, unless it is the first: that one gives the
    no-update text. Without any new week there is one row with NULL week and the no-update text.
    """
    mark = last_published_week(posts).scalar()
    fresh = settle(weekly_totals(panel).where((F.col("week") > mark) | mark.isNull()))
    weeks = fresh.groupBy("week").agg(
        F.coalesce(F.bool_and(F.col("state_new_cases") == 0), F.lit(False)).alias("empty"))
    first = weeks.agg(F.min("week")).scalar()
    stop = weeks.where(F.col("empty") & (F.col("week") > first)).agg(F.min("week")).scalar()

    quiet = (F.col("state_new_cases") == 0) & (F.col("moving_3wk_avg") == 0)
    line = F.when(quiet, F.concat("state", F.lit(f": {NO_LONGER}"))).otherwise(
        F.concat("state", F.lit(": "), _reported(F.col("state_new_cases")), F.lit(" ("),
                 number_text(half_even("moving_3wk_avg"), 0), F.lit(")")))
    intro = F.concat(F.lit("New Weekly Reported Cases by State for "), long_date("week"),
                     F.lit(" (3-week Moving Average in Parentheses)\n\n"))
    texts = join_lines(fresh, ["week"], line, "state", "lines")
    published = (weeks.join(texts, "week").where((F.col("week") < stop) | stop.isNull())
                 .select("week", F.when(F.col("empty"), F.lit(NO_UPDATE_WEEKLY))
                         .otherwise(F.concat(intro, F.col("lines"))).alias("text")))
    nothing = (weeks.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
               .select(F.lit(None).cast("date").alias("week"), F.lit(NO_UPDATE_WEEKLY).alias("text")))
    return published.unionByName(nothing)


def unallocated_table(panel: DataFrame, d: dt.date | str, states: Sequence[str]) -> DataFrame:
    """Counts without a county at one date, one column per state."""
    _, rest = split_unallocated(panel)
    return spread(at_date(rest, "date", d), ["date"], "state", "cases", states)


def stacked_shares(df: DataFrame, key: str, cat: str, value: str, by: str) -> DataFrame:
    """Shares of every category per key, with the position of the key when ordered by the share of ``by``."""
    shares = two_level_share(df, key, cat, value)
    levels = ordered_levels(shares.where(F.col(cat) == by).select(key, "prop"), key, "prop")
    return shares.join(levels.select(key, "level"), key, "left")


def profile(tables: Mapping[str, DataFrame], state: str, county: str) -> DataFrame:
    """Rows of one county from several tidy tables: ``(table, variable, estimate)``. Filters reach each scan."""
    parts = [t.where((F.col("State") == state) & (F.col("County") == county))
              .select(F.lit(name).alias("table"), "variable", "estimate") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
