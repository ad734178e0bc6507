"""Embedding near-duplicates: an exact metric range join.

Unit vectors with cosine 0.95 are 0.3162 apart. Pivots partition the vectors: each belongs to the cell of its nearest pivot.
By the triangle inequality a vector has neighbours in another cell only if it is no further from that cell's pivot than
the cell's radius plus the range, and no further beyond the plane between the two pivots than the range: only then is it
copied there. Cells are then joined independently; a vector finds all its neighbours in its own cell. Pivots only steer
how much work there is; every choice of them gives the same links.
"""

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelkit.llm.common import ship
from panelkit.llm.components import components, local_roots
from panelkit.session import settle

#: Bounds of the number of pivots (an eighth of the root of the distinct vectors in between). Vectors in one part of a cell,
#: of those at home and of all.
PIVOTS, HOME, ALL = (16, 1024), 2000, 8000
#: Slack for rounding when cells are chosen; links themselves are decided by the cosine alone.
SLACK = 1e-6


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v, ok)``: the vector in double precision; ok unless it is null, empty, zero, or holds a null, NaN or infinity."""
    v = F.col(vector)
    if v_type(df, vector) not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).alias("key"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("ok"))


def v_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest part first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (rows @ pivots.T), 0))


def _cells(classes: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``(node, v, n, cell, apart)``: each vector's own cell and its distance from that pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(unit(matrix(batch.column("v"), width)), pivots)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("node", "v", "n")] + [pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])],
                    ["node", "v", "n", "cell", "apart"])

    return classes.select("node", "v", "n").mapInArrow(run, f"node long, v {v_type(classes, 'v')}, n long, cell int, apart double")


def _copies(celled: DataFrame, pivots: np.ndarray, reach: np.ndarray, width: int, range_: float) -> DataFrame:
    """``(node, v, n, cell, home)``: each vector in its own cell and in those where it may have neighbours."""
    between = _distances(pivots, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _distances(unit(matrix(batch.column("v"), width)), pivots)
            home = batch.column("cell").to_numpy()
            own = away[np.arange(len(home)), home][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (away ** 2 - own ** 2) / (2 * between[home])
            near = (away <= reach + range_ + SLACK) & ~(beyond > range_ + SLACK)
            near[np.arange(len(home)), home] = True
            row, cell = np.nonzero(near)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(taken) for c in ("node", "v", "n")]
                + [pa.array(cell.astype(np.int32)), pa.array(cell == home[row])], ["node", "v", "n", "cell", "home"])

    return celled.mapInArrow(run, f"node long, v {v_type(celled, 'v')}, n long, cell int, home boolean")


def _joined(copies: DataFrame, width: int, cosine: float) -> DataFrame:
    """``(node, n_near, root)``: for each vector at home the number of vectors near it (copies of other classes counted
    singly), and a linked vector of its part; parts of a cell meet in pairs."""
    sizes = copies.groupBy("cell").agg(F.ceil(F.count_if("home") / HOME).cast("int").alias("homes"),
                                       F.ceil(F.count(F.lit(1)) / ALL).cast("int").alias("alls"))
    placed = copies.join(sizes, "cell")
    part = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    asks = placed.filter("home").select("cell", "node", "v", "n", part("homes").alias("i"), every("alls").alias("j"))
    given = placed.filter("homes > 0").select("cell", "node", "v", "n", part("alls").alias("j"), every("homes").alias("i"))
    rows = asks.select("cell", "i", "j", "node", "v", "n", F.lit(True).alias("asks")).unionByName(
        given.select("cell", "i", "j", "node", "v", "n", F.lit(False).alias("asks")))

    def join(part: pa.Table) -> pa.Table:
        asked = np.asarray(part.column("asks").to_numpy(), bool)
        node = part.column("node").to_numpy()
        count = part.column("n").to_numpy()
        rows = unit(matrix(part.column("v").combine_chunks(), width))
        mine, theirs = np.flatnonzero(asked), np.flatnonzero(~asked)
        near = np.zeros(len(mine), np.int64)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        names, place = np.unique(node, return_inverse=True)
        root = np.arange(len(names))
        for first in range(0, len(mine), 500):
            some = mine[first:first + 500]
            close = rows[some] @ rows[theirs].T >= cosine
            close &= node[some][:, None] != node[theirs][None]
            near[first:first + 500] = close @ count[theirs]
            i, j = np.nonzero(close)
            i, j = np.concatenate([place[some[i]], np.arange(len(names))]), np.concatenate([place[theirs[j]], root])
            root = local_roots(len(names), i, j)
        return pa.table({"node": node[mine], "n_near": near, "root": names[root[place[mine]]]})

    return rows.groupBy("cell", "i", "j").applyInArrow(join, "node long, n_near long, root long")


def range_links(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row: the number of other vectors with cosine of at least ``cosine``,
    the smallest key reachable over such links, and whether that is the row's own.

    Equal vectors are one class with a count, so copies of any number cost one vector. Vectors that are null, empty, zero,
    or hold null or non-finite parts link with nothing, nor do vectors of different length. Repeated keys stay rows; a null
    key counts as a vector and is a component's id only if there is no other. Labels and other columns are not read.
    """
    ship(df.sparkSession)
    rows = settle(usable(df, key, vector))
    fine = rows.filter("ok")
    # classes get a number of their own for the joins; written, it stays the same
    classes = settle(fine.groupBy("v").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
                     .withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("v")))
    widths = [(r["width"], r["count"]) for r in classes.groupBy("width").count().collect()]
    found = None
    for width, many in widths:
        same = classes.filter(F.col("width") == width)
        wanted = min(max(math.isqrt(many) // 8, PIVOTS[0]), PIVOTS[1])
        picked = same.orderBy(F.xxhash64("v"), "node").limit(wanted).select("v").collect()
        pivots = unit(np.array([r["v"] for r in picked], np.float64))
        celled = _cells(same, pivots, width)
        reach = np.full(len(pivots), -np.inf)
        for r in celled.groupBy("cell").agg(F.max("apart").alias("r")).collect():
            reach[r["cell"]] = r["r"]
        part = _joined(_copies(celled, pivots, reach, width, math.sqrt(2 - 2 * cosine)), width, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = settle(found)
    near = found.groupBy("node").agg(F.sum("n_near").alias("n_near"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(least, "root").join(near, "node", "left").select("v", "component", (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("links"))
    good = fine.join(named, "v").select("key", "links", "component")
    rest = rows.filter("NOT ok").select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("component"))
    return good.unionByName(rest).select(F.col("key").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                                         F.col("key").eqNullSafe(F.col("component")).alias("kept"))
