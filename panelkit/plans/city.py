"""City studies: one demographic share per ZIP code against the case or death rate."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelkit.functions import last_part, ratio
from panelkit.operators import category_share, cor_test, two_level_share, without_outliers
from panelkit.operators.correlation import correlation_of, tested
from panelkit.operators.shares import member
from panelkit.plans.census import acs_tidy, tidy_dictionary
from panelkit.plans.specs import ANCESTRY, CategorySpec
from panelkit.sources.census import acs_table
from panelkit.sources.tables import lookup


def city_measure(acs: DataFrame, variables: DataFrame, geos: DataFrame | None, spec: CategorySpec,
                 key: str = "GEOID") -> DataFrame:
    """One row per ZIP code with the measure of one demographic."""
    if spec.tidy is not None:
        rows = acs_tidy(acs, variables, spec.tidy, geos)
    else:
        names = variables.select("variable", last_part("label").alias("label"))
        rows = acs_table(acs, spec.table, geos, spec.drop, spec.codes).join(names, "variable", "left")
    if spec.members is None:
        return rows.select(key, F.col("estimate").alias(spec.name))
    return category_share(rows, key, spec.label, spec.members, "estimate", spec.name)


def city_table(covid: DataFrame, acs: DataFrame, variables: DataFrame, geos: DataFrame | None, spec: CategorySpec,
               response: str = "case_rate", above: float | None = None, ids: tuple[str, Sequence] | None = None) -> DataFrame:
    """``(GEOID, measure, response)`` without outliers; ``covid`` is keyed by ``zip``."""
    measure = city_measure(acs, variables, geos, spec)
    rates = covid.select(F.col("zip").alias("GEOID"), response)
    return without_outliers(measure.join(rates, "GEOID", "left"), response, above, ids)


def city_study(covid: DataFrame, acs: DataFrame, variables: DataFrame, geos: DataFrame | None, spec: CategorySpec,
               response: str = "case_rate", above: float | None = None, ids: tuple[str, Sequence] | None = None) -> DataFrame:
    """One row: the measure, and the correlation test of measure against response."""
    table = city_table(covid, acs, variables, geos, spec, response, above, ids)
    test = cor_test(table, spec.name, response)
    return test.select(F.lit(spec.name).alias("measure"), F.lit(response).alias("response"), *test.columns)


def _scope(spec: CategorySpec) -> Column:
    """Whether a census row belongs to the table and codes of a demographic."""
    table = spec.tidy or spec
    inside = F.col("variable").startswith(f"{table.table}_")
    if table.codes is not None:
        inside = inside & F.col("variable").isin(list(table.codes))
    return inside & ~F.col("variable").isin(list(table.drop)) if table.drop else inside


def _flags(variables: DataFrame, spec: CategorySpec, place: int) -> DataFrame:
    """The codes of a demographic in the dictionary: in its tidy table or not, and a member or not."""
    if spec.tidy is not None:
        labelled = tidy_dictionary(variables, spec.tidy)
    else:
        labelled = variables.select("variable", last_part("label").alias("label"))
    hit = F.lit(True) if spec.members is None else member(spec.label, spec.members)
    return labelled.where(_scope(spec)).select("variable", F.lit(True).alias(f"_known{place}"), hit.alias(f"_hit{place}"))


def city_values(acs: DataFrame, variables: DataFrame, geos: DataFrame | None, specs: Sequence[CategorySpec],
                key: str = "GEOID") -> DataFrame:
    """One row per area with an array of measures for each demographic (``_v0``, ``_v1``, ...): its share, or its estimates,
    none where the area has no member row.

    Labels are settled on the dictionary; the census rows are read once and shuffled once, as partial sums.
    """
    flags = [_flags(variables, spec, i) for i, spec in enumerate(specs)]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), flags)
    known = stacked.groupBy("variable").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in stacked.columns if c != "variable"])
    rows = acs.where(reduce(lambda x, y: x | y, [_scope(spec) for spec in specs]))
    if geos is not None:
        rows = rows.join(geos.select(key).distinct(), key, "left_semi")
    rows = rows.join(known, "variable", "left")
    sums, values = [], []
    for i, spec in enumerate(specs):
        inside = _scope(spec) & (F.coalesce(f"_known{i}", F.lit(False)) if spec.tidy is not None else F.lit(True))
        hit = inside & F.coalesce(f"_hit{i}", F.lit(False))
        value = F.col("estimate").cast("double")
        if spec.members is None:
            # as many as the table has codes
            sums.append(F.collect_list(F.when(inside, value)).alias(f"_v{i}"))
            values.append(F.col(f"_v{i}"))
            continue
        whole = F.when(F.count_if(inside & value.isNull()) == 0, F.sum(F.when(inside, value)))
        sums += [whole.alias(f"_n{i}"), F.sum(F.when(hit, value)).alias(f"_in{i}"), F.count_if(hit).alias(f"_rows{i}")]
        values.append(F.when(F.col(f"_rows{i}") > 0, F.array(ratio(f"_in{i}", f"_n{i}"))).otherwise(F.array().cast("array<double>"))
                      .alias(f"_v{i}"))
    return rows.groupBy(key).agg(*sums).select(key, *values)


def city_report(covid: DataFrame, acs: DataFrame, variables: DataFrame, geos: DataFrame | None,
                specs: Mapping[str, CategorySpec], response: str = "case_rate", above: float | None = None,
                ids: tuple[str, Sequence] | None = None) -> DataFrame:
    """The test rows of several demographics: census and cases are each read once, however many there are."""
    chosen = list(specs.values())
    rates = covid.select(F.col("zip").alias("GEOID"), response)
    areas = without_outliers(city_values(acs, variables, geos, chosen).join(rates, "GEOID", "left"), response, above, ids)
    each = areas.select(F.posexplode(F.array(*[f"_v{i}" for i in range(len(chosen))])).alias("place", "values"), F.col(response).alias("y"))
    pairs = each.select("place", F.explode("values").alias("x"), "y")
    tests = pairs.groupBy("place").agg(*correlation_of("x", "y"))
    names = lookup(acs.sparkSession, [(i, spec.name, response) for i, spec in enumerate(chosen)], "place int, measure string, response string")
    found = names.join(tests, "place", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return tested(found).drop("place")


def ancestry_shares(acs: DataFrame, variables: DataFrame, geos: DataFrame | None = None) -> DataFrame:
    """Share of each ancestry among the ancestries of its ZIP code."""
    return two_level_share(acs_tidy(acs, variables, ANCESTRY, geos), "GEOID", "label", "estimate")
