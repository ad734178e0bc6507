"""The county panel kept up to date: each week's files bring new days and corrected old ones, and little else changes.

A published panel is a list of partitions, one a state and month, each with the version that wrote it. A refresh compares a
digest of each county's months with the one kept from the last time, recomputes the tail of a county from its first changed
month on, and writes the partitions these tails touch as a new version; all other partitions stay the files they are. The
list is written last, so readers see the old panel or the new one, and a refresh that was cut short leaves nothing visible.
"""

from collections.abc import Sequence
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelkit.plans.panel import IDS, packed_counties, panel_days
from panelkit.plans.specs import STATES
from panelkit.session import settle

#: A partition's columns: version that wrote it, state ("~" without one), month; and those of the panel.
PARTITION = "version int, in_state string, month string"
PANEL = ("county_name string, state string, date date, cases double, deaths double, population double, case_rate double, death_rate double, "
         "new_cases double, moving_7_day_avg double, avg_7_day_rate double, NAME string, name_short string")
#: Rows before a changed one that a change or mean of seven rows looks back on.
BACK = 7


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions below ``path``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lists/*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The panel as the newest version, or an older one, lists it; None if nothing is published. Only listed partitions are
    read."""
    known = versions(spark, path)
    if not known:
        return None
    parts = spark.read.parquet(f"{path}/lists/{version or known[-1]}")
    rows = spark.read.schema(f"{PANEL}, {PARTITION}").parquet(f"{path}/panel")
    return rows.join(F.broadcast(parts), ["version", "in_state", "month"], "left_semi").drop("version", "in_state", "month")


def refresh_panel(cases: DataFrame, deaths: DataFrame, pop: DataFrame, path: str, states: Sequence[str] | None = STATES,
                  clamp: str = "after", include_unallocated: bool = False, names: DataFrame | None = None) -> DataFrame:
    """Bring the panel published below ``path`` up to the given wide tables, and return it: equal to ``build_panel`` of them.

    Dates are column names like 2020-01-31. Counties that are gone leave the panel; months may not go, and ``clamp`` may not
    change between refreshes. Without any change no version is written. One refresh may run at a time.
    """
    spark = cases.sparkSession
    counties, names_of_dates = packed_counties(cases, deaths, pop, states, include_unallocated, names)
    order = sorted(range(len(names_of_dates)), key=lambda i: names_of_dates[i])
    dates = [dt.date.fromisoformat(names_of_dates[i]) for i in order]
    months = sorted({f"{d:%Y-%m}" for d in dates})
    starts = [next(i for i, d in enumerate(dates) if f"{d:%Y-%m}" == m) for m in months]
    ends = [*starts[1:], len(dates)]
    blank = F.array_repeat(F.lit(None).cast("string"), len(dates))
    # the arrays in the order of the dates; a county missing from one table has none there
    places = F.array(*[F.lit(i) for i in order])

    def in_order(c: str) -> Column:
        cells = F.coalesce(F.col(c).cast("array<string>"), blank)
        return F.transform(places, lambda i: F.get(cells, i)).alias(c)

    rows = counties.select(*IDS, "state_name", "population", in_order("cases"), in_order("deaths"))
    digest = lambda a, b: F.xxhash64("state_name", "population", *[F.coalesce(F.array_join(F.slice(F.col(c), F.lit(a + 1), F.lit(b - a)), ",", "~"), F.lit("")) for c in ("cases", "deaths")])
    now = settle(rows.withColumn("digests", F.map_from_arrays(F.array(*[F.lit(m) for m in months]), F.array(*[digest(a, b) for a, b in zip(starts, ends)]))))

    known = versions(spark, path)
    if known:
        before = spark.read.parquet(f"{path}/digests/{known[-1]}")
        lost = before.select(F.explode(F.map_keys("digests")).alias("month")).distinct().filter(~F.col("month").isin(months)).limit(1).collect()
        if lost:
            raise ValueError(f"the files lack a published month: {lost[0]['month']}")
        old = spark.read.parquet(f"{path}/lists/{known[-1]}")
    else:
        before = now.limit(0).select(*IDS, "digests")
        old = spark.createDataFrame([], PARTITION)
    number = (known[-1] if known else 0) + 1
    # null-safe: a county or state without a name is a county too
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDS]
    place = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(months)])
    met = now.alias("a").join(before.select(*IDS, F.col("digests").alias("old")).alias("b"), same, "left")
    changed = F.filter(place, lambda p: F.coalesce(F.try_element_at("old", p["m"]) != F.try_element_at("digests", p["m"]), F.lit(True)))
    tails = settle(met.select(*[F.col(f"a.{c}").alias(c) for c in IDS], "state_name", "population", "cases", "deaths",
                              F.get(changed, F.lit(0))["i"].alias("first")).filter("first IS NOT NULL"))
    gone = settle(before.alias("a").join(now.alias("b"), same, "left_anti").select(*IDS, F.lit(0).alias("first")))
    moved = tails.select(*IDS, "first").unionByName(gone)
    touched = settle(moved.groupBy(F.coalesce("state", F.lit("~")).alias("in_state")).agg(F.min("first").alias("first"))
                     .select("in_state", F.explode(F.slice(F.array(*[F.lit(m) for m in months]), F.col("first") + 1, F.lit(len(months)))).alias("month")))
    if touched.isEmpty():
        return published(spark, path)

    # a tail needs the rows before it that its means look back on; they are computed beside it and not written
    from_row = F.greatest(F.get(F.array(*[F.lit(s) for s in starts]), "first") - BACK, F.lit(0))
    cut = lambda c: F.slice(c, from_row + 1, F.lit(len(dates)))
    days = F.arrays_zip(cut(F.array(*[F.lit(d) for d in dates])).alias("date"), cut("cases").alias("cases"), cut("deaths").alias("deaths"))
    long = tails.repartition(*IDS).select(*IDS, "state_name", "population", "first", F.explode(days).alias("d")).select(
        *IDS, "state_name", "population", "first", F.col("d.date").alias("date"), F.col("d.cases").alias("cases"), F.col("d.deaths").alias("deaths"))
    month = F.date_format("date", "yyyy-MM")
    begin = tails.select(*IDS, F.get(F.array(*[F.lit(m) for m in months]), "first").alias("begin"))
    fresh = panel_days(long.drop("first"), clamp).withColumn("month", month)
    fresh = fresh.alias("a").join(begin.alias("b"), same).filter("month >= begin").select("a.*")
    parts = fresh
    current = published(spark, path)
    if current is not None:
        in_state = F.coalesce("state", F.lit("~")).alias("in_state")
        kept = current.withColumn("month", month).withColumn("in_state", in_state).join(touched, ["in_state", "month"], "left_semi").drop("in_state")
        # rows of counties that did not change, and those before a changed tail
        left = moved.select(*IDS, F.get(F.array(*[F.lit(m) for m in months]), "first").alias("begin"))
        kept = kept.alias("a").join(left.alias("b"), [*same, F.col("a.month") >= F.col("b.begin")], "left_anti")
        parts = kept.unionByName(fresh)
    target = f"{path}/panel/version={number}"
    (parts.withColumn("in_state", F.coalesce("state", F.lit("~"))).repartition("in_state", "month").write.mode("overwrite")
     .partitionBy("in_state", "month").parquet(target))
    now.select(*IDS, "digests").write.mode("overwrite").parquet(f"{path}/digests/{number}")
    written = spark.read.schema(f"{PANEL}, {PARTITION}").parquet(f"{path}/panel").filter(F.col("version") == number).select("version", "in_state", "month").distinct()
    listed = old.join(touched, ["in_state", "month"], "left_anti").unionByName(written.select(*old.columns))
    listed.write.mode("overwrite").parquet(f"{path}/lists/{number}")
    return published(spark, path)
