"""Staged census rows ``(GEOID, NAME, variable, estimate, moe)``."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def acs_table(acs: DataFrame, table: str, geos: DataFrame | None = None, drop: Sequence[str] = (),
              codes: Sequence[str] | None = None) -> DataFrame:
    """Rows of one census table for the geographies in ``geos`` (a frame with ``GEOID``).

    The code prefix and the code lists are plain predicates on ``variable`` and reach the scan.
    """
    rows = acs.where(F.col("variable").startswith(f"{table}_"))
    if codes is not None:
        rows = rows.where(F.col("variable").isin(list(codes)))
    if drop:
        rows = rows.where(~F.col("variable").isin(list(drop)))
    if geos is not None:
        rows = rows.join(geos.select("GEOID").distinct(), "GEOID", "left_semi")
    return rows
