"""Census rows to tidy dimension tables, driven by a specification per table."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.functions import flag, group_of, label_depth, last_part
from panelkit.operators.reshape import split_label
from panelkit.plans.specs import TidySpec
from panelkit.sources.census import acs_table


def _named_by_text(c: Column, rules, default: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, name in rules:
        out = out.when(c.contains(part), F.lit(name))
    return out.otherwise(F.lit(default))


def tidy_dictionary(variables: DataFrame, spec: TidySpec) -> DataFrame:
    """Apply every label rule to the dictionary ``(variable, label)`` of one table.

    A table has at most some hundred codes, so text work happens once per code and not once per census row.
    ``label_ord`` (or ``<dim>_ord``) keeps the order in which labels first appear in the table.
    """
    d = variables.select("variable", "label").where(F.col("variable").startswith(f"{spec.table}_"))
    d = d.where(~F.col("variable").isin(list(spec.drop))) if spec.drop else d
    d = d.where(F.col("variable").isin(list(spec.codes))) if spec.codes is not None else d
    if spec.depth_from is not None:
        d = d.where(label_depth("label") >= spec.depth_from)
    if spec.depth_is is not None:
        d = d.where(label_depth("label") == spec.depth_is)
    for pattern in spec.reject:
        d = d.where(~F.col("label").rlike(pattern))
    label = last_part("label") if spec.last else F.col("label")
    for text in spec.remove:
        label = F.replace(label, F.lit(text), F.lit(""))
    for old, new in spec.rewrite:
        label = F.replace(label, F.lit(old), F.lit(new))
    d = d.withColumn("label", label)
    names = ["label"]
    if spec.into:
        d, names = split_label(d, "label", spec.into), list(spec.into)
    for c, (value, then, otherwise) in spec.flags.items():
        d = d.withColumn(c, flag(c, value, then, otherwise))
    for c, (rules, default) in spec.contains.items():
        d = d.withColumn(c, _named_by_text(F.col(c), rules, default))
    for c, (groups, default) in spec.groups.items():
        d = d.withColumn(c, group_of(c, groups, default))
    for c, groups in spec.by_code.items():
        d = d.withColumn(c, group_of("variable", groups))
    for c, value in spec.fill.items():
        d = d.withColumn(c, F.coalesce(c, F.lit(value)))
    d = d.withColumn("_table", F.substring_index("variable", "_", 1)).repartition("_table")
    for c in names:
        first = F.min("variable").over(Window.partitionBy("_table", c))
        d = d.withColumn("_first", first).withColumn(
            f"{c}_ord", F.dense_rank().over(Window.partitionBy("_table").orderBy("_first")))
    return d.drop("_table", "_first")


def split_place(df: DataFrame) -> DataFrame:
    """``Cook County, Illinois`` to County ``Cook`` and State ``Illinois``; NAME stays."""
    parts = F.split("NAME", " County,")
    return df.withColumns({"County": F.get(parts, F.lit(0)), "State": F.trim(F.get(parts, F.lit(1)))})


def acs_tidy(acs: DataFrame, variables: DataFrame, spec: TidySpec, geos: DataFrame | None = None) -> DataFrame:
    """Rows of one census table with its tidy dimensions; rows outside the specification are left out."""
    rows = acs_table(acs, spec.table, geos, spec.drop, spec.codes)
    return rows.join(tidy_dictionary(variables, spec), "variable")
