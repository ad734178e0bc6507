"""The feature master: one row per area, population counts and shares from several census tables."""

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.functions import ratio
from panelkit.operators import apply_linear
from panelkit.plans.census import tidy_dictionary
from panelkit.plans.specs import CASE_RATE_FORMULA, FEATURES, FeatureSpec


def _membership(variables: DataFrame, spec: FeatureSpec, block: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """The codes of one block with a flag per feature: does this code count towards it?

    A feature is the part of the block's total that shares some dimensions with its representative code.
    Returns the flagged codes and ``{feature: (flag column, representative code)}``.
    """
    d = tidy_dictionary(variables, spec.tidy).select("variable", *spec.dims)
    table = Window.partitionBy(F.substring_index("variable", "_", 1))
    codes = list(spec.pick)
    d = d.withColumns({f"_{i}_{dim}": F.max(F.when(F.col("variable") == code, F.col(dim))).over(table)
                       for i, code in enumerate(codes) for dim in spec.dims})
    flags, columns = {}, {block: F.lit(True)}
    for i, code in enumerate(codes):
        for column, feature in spec.pick[code].items():
            dims = [dim for dim in spec.dims if f"_{dim}_" in f"{column}_"]
            if column != "prop_" + "_".join(dims):
                raise ValueError(f"no subset of {spec.dims}: {column}")
            flag = f"{block}_{len(flags)}"
            columns[flag] = reduce(lambda x, y: x & y, [F.col(dim) == F.col(f"_{i}_{dim}") for dim in dims])
            flags[feature] = (flag, code)
    return d.select("variable", *[c.alias(n) for n, c in columns.items()]), flags


def feature_master(acs: DataFrame, variables: DataFrame, geos: DataFrame | None = None,
                   specs: Mapping[str, FeatureSpec] = FEATURES, key: str = "GEOID") -> DataFrame:
    """One row per area: population counts first, then the features of every block.

    All label logic is settled on the dictionary. What is left of the blocks, their subset shares, the picks
    and the joins between blocks is one grouped aggregate of conditional sums: census rows are read once and
    shuffled once, as partial sums. A feature is NULL for areas that lack its representative code, and areas
    without any of these codes are left out.
    """
    parts = [(f"_b{i}", spec, *_membership(variables, spec, f"_b{i}")) for i, spec in enumerate(specs.values())]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [codes for _, _, codes, _ in parts])
    members = stacked.groupBy("variable").agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in stacked.columns if c != "variable"])

    tables = sorted({spec.tidy.table for spec in specs.values()})
    rows = acs.where(reduce(lambda x, y: x | y, [F.col("variable").startswith(f"{t}_") for t in tables]))
    if geos is not None:
        rows = rows.join(geos.select(key).distinct(), key, "left_semi")
    rows = rows.join(members, "variable")

    def total(condition: str, na_rm: bool) -> Column:
        value = F.sum(F.when(F.col(condition), F.col("estimate")))
        return value if na_rm else F.when(F.count_if(F.col(condition) & F.col("estimate").isNull()) == 0, value)

    sums, counts, features = [], [], []
    codes = sorted({code for spec in specs.values() for code in spec.pick})
    has = {code: f"_has{i}" for i, code in enumerate(codes)}
    for block, spec, _, flags in parts:
        sums.append(total(block, spec.na_rm).alias(block))
        if spec.total:
            counts.append(F.when(F.col(has[next(iter(spec.pick))]) > 0, F.col(block)).alias(spec.total))
        for feature, (flag, code) in flags.items():
            sums.append(total(flag, spec.na_rm).alias(flag))
            features.append(F.when(F.col(has[code]) > 0, ratio(flag, block)).alias(feature))
    found = [F.count_if(F.col("variable") == code).alias(name) for code, name in has.items()]
    areas = rows.groupBy(key).agg(*sums, *found)
    return areas.where(reduce(lambda x, y: x | y, [F.col(n) > 0 for n in has.values()])).select(key, *counts, *features)


def feature_block(acs: DataFrame, variables: DataFrame, geos: DataFrame | None, spec: FeatureSpec,
                  key: str = "GEOID") -> DataFrame:
    """The features of one census table alone."""
    return feature_master(acs, variables, geos, {"block": spec}, key)


def predict_case_rate(master: DataFrame) -> DataFrame:
    """The published linear formula applied to the feature master."""
    return apply_linear(master.withColumn("prop_hisp", 1 - F.col("prop_not_His")), CASE_RATE_FORMULA, "case_rate_fit")
