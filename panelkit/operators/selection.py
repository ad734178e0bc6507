"""Order statistics without a sort: histograms of the bits of a number, refined around the places that are asked for.

A double's bits, read as a whole number with the sign put right, are in the order of the doubles. A first scan counts rows by
the upper bits; the bins that hold the wanted places are then counted by more bits, and again until a bin holds one value:
two scans as a rule, three at most. Counts are combined before they are shuffled; a group is never in one task as rows.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.session import settle
from panelkit.sources.tables import lookup

#: Bits that the scans leave out: sign, exponent and 9 bits of the fraction first, then 22 more, then all.
SHIFTS = (43, 21, 0)
LARGEST = (1 << 63) - 1


def with_bits(df: DataFrame, value: str, name: str = "_bits") -> DataFrame:
    """Add a whole number for each double, in the same order: equal for equal values (both zeros are one), NaN last, NULL for
    NULL.

    Only built-in functions, in steps, so that none is computed twice: the exponent by a logarithm that is then put right,
    the fraction by scaling with powers of two, which is exact.
    """
    c, size, guess = F.col(value), F.abs(value), F.col("_guess")
    near = df.withColumn("_guess", F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(size))).cast("int")))
    near = near.withColumn("_power", F.pow(F.lit(2.0), guess.cast("double")))
    # the logarithm of a number beside a power of two may round to the other side: its fraction is then not in [1, 2)
    scaled = near.withColumn("_part", size / F.col("_power"))
    low, high = F.col("_part") < 1, (F.col("_part") >= 2) & (guess < 1023)
    exponent = guess + F.when(low, -1).when(high, 1).otherwise(0)
    fraction = F.col("_part") * F.when(low, 2.0).when(high, 0.5).otherwise(1.0) * F.lit(float(1 << 52))
    normal = F.shiftleft((exponent + 1022).cast("long"), 52) + fraction.cast("long")
    subnormal = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    whole = scaled.withColumn("_whole", F.when(size < F.lit(2.0 ** -1022), subnormal).when(size == F.lit(float("inf")), F.lit(2047 << 52))
                              .when(~F.isnan(c), normal).otherwise(F.lit(LARGEST)))
    bits = F.when(c < 0, -F.col("_whole")).otherwise(F.col("_whole"))
    return whole.withColumn(name, F.when(c.isNotNull(), bits)).drop("_guess", "_power", "_part", "_whole")


def order_statistics(df: DataFrame, value: str, places: Callable[[Column], Sequence[Column]], by: Sequence[str] = (),
                     extra: Sequence[Column] = ()) -> DataFrame:
    """``(by, total, v0, v1, ..., e0, ...)``: for each group the number of its values, and those at ``places`` of them in
    ascending order.

    ``places`` makes columns of places from 1 out of the column of totals. NULL values are not counted; a group without a
    value has NULLs, as has the one row of an empty table without groups. ``extra`` are summed over the rows, ``_x`` being the
    value, in the first scan.
    """
    group = F.struct(*by) if by else F.lit(0)  # structs are equal where both have a NULL
    rows = with_bits(df.select(group.alias("_g"), F.col(value).cast("double").alias("_x")), "_x")
    ends = [F.count("_x").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]
    sums = [f"e{i}" for i in range(len(extra))]
    if not by:
        return _of_all(rows, places, ends, [F.sum(c).alias(n) for c, n in zip(extra, sums)])
    # counts, not rows: some thousand bins a group
    first = settle(rows.groupBy("_g", F.shiftright("_bits", SHIFTS[0]).alias("_bin")).agg(*ends, *[F.sum(c).alias(n) for c, n in zip(extra, sums)]))
    totals = first.groupBy("_g").agg(F.sum("_n").alias("total"), *[F.sum(n).alias(n) for n in sums])
    asked = totals.filter("total > 0").select("_g", F.posexplode(F.array(*[p.cast("long") for p in places(F.col("total"))])).alias("_i", "_left"))

    def located(bins: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """The bin that holds each wanted place, and the place within it."""
        upto = bins.filter("_bin IS NOT NULL").withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin")))
        before = F.col("_upto") - F.col("_n")
        met = wanted.join(upto, keys).filter((F.col("_left") <= F.col("_upto")) & (F.col("_left") > before))
        return settle(met.select("_g", "_i", (F.col("_left") - before).alias("_left"), "_bin", "_low", "_high"))  # a few rows a group

    state = located(first, asked, ["_g"])
    for before, shift in zip(SHIFTS, SHIFTS[1:]):
        open_ = state.filter("_low < _high").withColumnRenamed("_bin", "_outer")
        if open_.isEmpty():
            break
        inner = rows.withColumn("_outer", F.shiftright("_bits", before)).join(open_.select("_g", "_outer").distinct(), ["_g", "_outer"], "left_semi")
        bins = inner.groupBy("_g", "_outer", F.shiftright("_bits", shift).alias("_bin")).agg(*ends)
        state = state.filter("NOT _low < _high").unionByName(located(bins, open_.select("_g", "_outer", "_i", "_left"), ["_g", "_outer"]))
    picks = [F.max(F.when(F.col("_i") == i, F.col("_low"))).alias(f"v{i}") for i in range(len(places(F.lit(1))))]
    found = totals.join(state.groupBy("_g").agg(*picks), "_g", "left")
    shown = [c for c in found.columns if c != "_g"]
    return found.select(*[F.col(f"_g.`{c}`").alias(c) for c in by], *[F.coalesce(c, F.lit(0)).alias(c) if c == "total" else c for c in shown])


def _of_all(rows: DataFrame, places: Callable[[Column], Sequence[Column]], ends: list[Column], sums: list[Column]) -> DataFrame:
    """The same for all rows as one group: the driver sees bins, some thousands as a rule and 2^21 at most, and no rows."""
    spark = rows.sparkSession
    first = rows.groupBy(F.shiftright("_bits", SHIFTS[0]).alias("_bin")).agg(*ends, *sums)
    bins = first.collect()
    total = sum(b["_n"] for b in bins)
    at = lookup(spark, [(total,)], "total long").select(F.array(*[p.cast("long") for p in places(F.col("total"))])).first()[0]

    def located(found: list, left: int):
        """The bin that holds a place, and the place within it."""
        for b in sorted((b for b in found if b["_bin"] is not None), key=lambda b: b["_bin"]):
            if left <= b["_n"]:
                return left, b
            left -= b["_n"]

    state = [located(bins, p) for p in at] if total else []
    for before, shift in zip(SHIFTS, SHIFTS[1:]):
        outer = sorted({b["_bin"] for _, b in state if b["_low"] < b["_high"]})
        if not outer:
            break
        inner = F.shiftright("_bits", before)
        found = rows.filter(inner.isin(outer)).groupBy(inner.alias("_outer"), F.shiftright("_bits", shift).alias("_bin")).agg(*ends).collect()
        state = [located([b for b in found if b["_outer"] == held["_bin"]], left) if held["_low"] < held["_high"] else (left, held) for left, held in state]
    values = [b["_low"] for _, b in state] if total else [None] * len(at)
    kinds = [f for f in first.schema if f.name.startswith("e")]
    known = [[b[f.name] for b in bins if b[f.name] is not None] for f in kinds]
    schema = ", ".join(["total long", *[f"v{i} double" for i in range(len(at))], *[f"{f.name} {f.dataType.simpleString()}" for f in kinds]])
    return lookup(spark, [(total, *values, *[sum(k) if k else None for k in known])], schema)
