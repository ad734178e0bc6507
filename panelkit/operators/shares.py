"""Shares of a group total.

Totals come from a grouped aggregate that combines before the shuffle, and are joined back to the detail.
A group that holds a large part of all rows so never has to fit one window task: the aggregate shrinks it on
the map side, and adaptive execution broadcasts a small table of totals or splits a skewed join.
"""

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelkit.functions import ratio, sum_strict
from panelkit.operators.joins import group_join


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _sum(value: str | Column, na_rm: bool) -> Column:
    return F.sum(value) if na_rm else sum_strict(value)


def _window_sum(value: str, w: WindowSpec, na_rm: bool) -> Column:
    total = F.sum(value).over(w)
    return total if na_rm else F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), total)


def with_total(df: DataFrame, key: str | Sequence[str], value: str, name: str = "n", na_rm: bool = False) -> DataFrame:
    """Every row with the total of its group."""
    keys = _list(key)
    totals = df.groupBy(*keys).agg(_sum(value, na_rm).alias(name))
    return group_join(df, totals, keys)


def share(df: DataFrame, key: str | Sequence[str], value: str, name: str = "prop", na_rm: bool = False) -> DataFrame:
    """Every row with ``n``, its group total, and its share of it."""
    rows = with_total(df, key, value, "_total", na_rm)
    return rows.withColumns({name: ratio(value, "_total"), "n": F.col("_total")}).drop("_total")


def two_level_share(df: DataFrame, key: str, cat: str | Sequence[str], value: str, na_rm: bool = False) -> DataFrame:
    """One row per key and category: ``count``, the key's ``pop``, and ``prop``.

    After the first aggregate a key holds one row per category, so the second level is a small window.
    """
    cells = df.groupBy(key, *_list(cat)).agg(_sum(value, na_rm).alias("count"))
    pop = _window_sum("count", Window.partitionBy(key), na_rm)
    return cells.withColumn("pop", pop).withColumn("prop", ratio("count", "pop"))


def member(label: str, members: Sequence[str] | str | Callable[[Column], Column]) -> Column:
    """Whether a label is in a list, matches a regular expression, or fulfils a predicate."""
    c = F.col(label)
    if callable(members):
        return members(c)
    return c.rlike(members) if isinstance(members, str) else c.isin(list(members))


def category_share(df: DataFrame, key: str, label: str, members: Sequence[str] | str | Callable[[Column], Column],
                   value: str, name: str, na_rm: bool = False) -> DataFrame:
    """One row per key: the part of its total that falls on the member labels.

    ``members`` is a list of labels, a regular expression, or a predicate on the label. Share, filter, sum and
    distinct collapse into one conditional aggregate. A key without any member row is left out.
    """
    hit = member(label, members)
    sums = df.groupBy(key).agg(
        _sum(value, na_rm).alias("_n"),
        F.sum(F.when(hit, F.col(value))).alias("_in"),
        F.count_if(hit).alias("_rows"),
    )
    return sums.where(F.col("_rows") > 0).select(key, ratio("_in", "_n").alias(name))


def _subsets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [s for size in range(len(dims) + 1) for s in combinations(dims, size)]


def subset_totals(df: DataFrame, key: str, dims: Sequence[str], value: str, na_rm: bool = False) -> DataFrame:
    """Long form over all subsets of the dimensions: sum, key total and share.

    ``subset`` names the dimensions in use, joined by ``+``; the others are NULL. Rows are first summed to
    cells, few per key. The cells move to their key once, unless they lie there already, and take its total; they are
    repeated per subset there, and the subset sums are formed in place.
    """
    cells = df.groupBy(key, *dims).agg(_sum(value, na_rm).alias("_v"))
    cells = cells.withColumn("_pop", _window_sum("_v", Window.partitionBy(key), na_rm))
    kinds = dict(df.dtypes)
    subsets = F.array(*[
        F.struct(F.lit("+".join(s)).alias("subset"),
                 *[(F.col(d) if d in s else F.lit(None).cast(kinds[d])).alias(d) for d in dims])
        for s in _subsets(dims)])
    rows = cells.select(key, "_v", "_pop", F.inline(subsets))
    totals = rows.groupBy(key, "subset", *dims).agg(_sum("_v", na_rm).alias("_total"), F.first("_pop").alias("pop"))
    # the sum over no dimension is the key total itself, to the last digit
    total = F.when(F.col("subset") == "", F.col("pop")).otherwise(F.col("_total"))
    return (totals.select(key, *dims, "subset", total.alias("total"), "pop")
            .withColumn("prop", ratio("total", "pop")))


def _chains(dims: Sequence[str]) -> list[list[str]]:
    """As few orders of dimensions as possible whose beginnings are all proper subsets: each size is matched with the next."""
    level = [[s for s in map(frozenset, _subsets(dims)) if len(s) == size] for size in range(len(dims))]
    below: dict[frozenset, frozenset] = {}

    def place(part: frozenset, seen: set) -> bool:
        for whole in level[len(part) + 1]:
            if part < whole and whole not in seen:
                seen.add(whole)
                if whole not in below or place(below[whole], seen):
                    below[whole] = part
                    return True
        return False

    for sets in level[1:-1]:
        for part in sets:
            place(part, set())
    chains = []
    for top in (s for sets in level[1:] for s in sets if s not in below.values()):
        order, inside = [], top
        while inside:
            inner = below.get(inside, frozenset())
            order += [d for d in dims if d in inside - inner]
            inside = inner
        chains.append(order[::-1])
    return chains


def subset_cells(df: DataFrame, key: str, dims: Sequence[str], value: str, total: str = "zip_pop",
                 na_rm: bool = False) -> DataFrame:
    """One row per key and cell, with the key total and the share of every non-empty subset of the dimensions.

    Share columns read ``prop_<dim>_<dim>``. The windows run over cells, whose number per key is the product
    of the dimension sizes; all of them reuse the one exchange on the key. Subsets are taken in chains, each the beginning
    of the one before, so that a chain is sorted once.
    """
    cells = df.groupBy(key, *dims).agg(_sum(value, na_rm).alias("_v")).repartition(F.col(key))

    def over(*by: str) -> Column:
        return _window_sum("_v", Window.partitionBy(key, *by), na_rm)

    # sorted once by the whole chain, the rows are in order for all its beginnings, and for the key alone
    out = cells
    for chain in _chains(dims):
        out = out.sortWithinPartitions(key, *chain)
        if total not in out.columns:
            out = out.withColumn(total, over())
        for size in range(1, len(chain) + 1):
            name = "prop_" + "_".join(d for d in dims if d in chain[:size])
            if name not in out.columns:
                out = out.withColumn(name, ratio(over(*chain[:size]), total))
    if total not in out.columns:
        out = out.withColumn(total, over())
    out = out.withColumn("prop_" + "_".join(dims), ratio("_v", total))
    return out.select(key, *dims, total, "prop_" + "_".join(dims), *["prop_" + "_".join(s) for s in _subsets(dims)[1:-1]])


def subset_shares(df: DataFrame, key: str, dims: Sequence[str], value: str, total: str = "zip_pop",
                  na_rm: bool = False, only: Column | None = None) -> DataFrame:
    """Rows of ``df`` (those that fit ``only``) with the shares of all subsets their cell belongs to."""
    cells = subset_cells(df, key, dims, value, total, na_rm)
    rows = df if only is None else df.where(only)
    return group_join(rows, cells, [key, *dims])


def mean_above(df: DataFrame, rate: str, share_col: str, t: float) -> DataFrame:
    """Mean rate of the entities whose share exceeds ``t``, beside the mean over all."""
    above = F.col(share_col) > t
    return df.agg(F.avg(F.when(above, F.col(rate))).alias("mean_above"), F.avg(rate).alias("mean_all"),
                  F.count_if(above).alias("n_above"))
