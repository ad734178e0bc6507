"""Exact positions in a global order, without a window over the whole table.

Sort once by range, number the rows inside each partition, and add what the partitions before hold. The
only thing the driver sees is one number per partition.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.session import settle
from panelkit.sources.tables import lookup

ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def running_total(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows up to and including this one."""
    return _with_running(df, order, weight, name)[0]


def _with_running(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> tuple[DataFrame, int]:
    """The rows with their running total, and the total over all.

    ``order`` must tell all rows apart (add a key as the last column, or group equal values first);
    range partitions then stay even, whatever value is frequent.
    """
    tagged = settle(df.withColumn("_w", weight.cast("long")).orderBy(*order)
                      .withColumn("_pos", F.monotonically_increasing_id())
                      .withColumn("_part", F.shiftright("_pos", ROW_BITS)))
    sizes = sorted(tagged.groupBy("_part").agg(F.sum("_w").alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = lookup(df.sparkSession, offsets, "_part long, _start long")
    # every range stays one task of its own: hashing a few part numbers would put several of them together
    apart = tagged.repartitionById(max(1, max((part for part, _ in offsets), default=0) + 1), F.col("_part").cast("int"))
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy("_pos"))
    rows = (apart.withColumn("_inside", inside).join(starts, "_part")
                  .withColumn(name, F.col("_start") + F.col("_inside"))
                  .drop("_w", "_pos", "_part", "_inside", "_start"))
    return rows, before


def ordered_levels(df: DataFrame, key: str, by: str, descending: bool = False, name: str = "level") -> DataFrame:
    """Position of every key when ordered by a measure; equal measures are ordered by key."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return running_total(df.select(key, by), [first, F.col(key)], F.lit(1), name)


def top_k(df: DataFrame, by: str, k: int, tie: str | Sequence[str], descending: bool = True) -> DataFrame:
    """The ``k`` rows with the largest measure; each task keeps only its own ``k``."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(first, *ties).limit(k)


def ranked_values(df: DataFrame, col: str, count: Column | None = None) -> tuple[DataFrame, int]:
    """Distinct non-null values of ``col`` as ``(value, n, upto)``, and the number of rows with a value.

    ``n`` is how often a value occurs, ``upto`` how many rows are not above it. With ``count`` a row stands for
    that many rows.
    """
    times = F.lit(1) if count is None else count
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value"), times.alias("times"))
    values = rows.groupBy("value").agg(F.sum("times").alias("n"))
    return _with_running(values, [F.col("value")], F.col("n"), "upto")
