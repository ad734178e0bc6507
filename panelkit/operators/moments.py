"""Counts, means, centred cross-products and triangular factors of many columns in one pass.

Each task works on whole Arrow batches and keeps one partial per fold; partials are merged two by two, first within a few
tasks and then on the driver, which sees matrices as wide as the number of columns and no rows. Cross-products are merged with
the update that never subtracts large sums. Triangular factors (QR of each batch, then of two factors one on the other) keep
the digits that squaring the columns would lose. Workers need not have this package: the functions themselves are shipped.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups of tasks whose partials are merged before the driver; adaptive execution puts groups of few bytes together.
MERGERS = 64


@dataclass
class Moments:
    """Count, means and centred cross-products of a set of columns."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * other.n / n,
                       self.cross + other.cross + np.outer(gap, gap) * self.n * other.n / n)


@dataclass
class PairMoments:
    """For every pair ``(i, j)`` over the rows where both are present: count, mean of i, centred cross-product, and centred
    square of i; ``rows`` counts all rows."""

    rows: int
    n: np.ndarray
    mean: np.ndarray
    cross: np.ndarray
    square: np.ndarray

    def correlation(self) -> np.ndarray:
        """NaN where a column is constant or fewer than two rows are shared."""
        size = np.sqrt(self.square) * np.sqrt(self.square.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((size > 0) & (self.n > 1), np.clip(self.cross / size, -1, 1), np.nan)


def _batch(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """``(n, mean, cross, square)`` of every pair in a batch, stacked."""
    if seen.all():
        middle = x.mean(axis=0)
        centred = x - middle
        cross, wide = centred.T @ centred, np.ones((x.shape[1], x.shape[1]))
        return np.stack([wide * len(x), middle[:, None] * wide, cross, np.diag(cross)[:, None] * wide])
    count = seen.sum(axis=0)
    middle = np.divide(np.where(seen, x, 0).sum(axis=0), count, out=np.zeros(x.shape[1]), where=count > 0)
    centred = np.where(seen, x - middle, 0.0)
    held = seen.astype(np.float64)
    n, total = held.T @ held, centred.T @ held
    mean = np.divide(total, n, out=np.zeros_like(n), where=n > 0)
    cross = centred.T @ centred - mean * total.T
    square = (centred * centred).T @ held - mean * total
    return np.stack([n, middle[:, None] + mean, cross, np.maximum(square, 0)])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    both = a[0] * share
    return np.stack([n, mean, a[2] + b[2] + gap * gap.T * both, a[3] + b[3] + gap * gap * both])


def _partials(df: DataFrame, cols: Sequence[str], fold: Column) -> dict[object, np.ndarray]:
    """Merged ``(n, mean, cross, square)`` by fold."""
    k = len(cols)
    schema = "fold long, part array<double>"

    def out(held: dict) -> pa.RecordBatch:
        parts = [p.ravel().tolist() for p in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], ["fold", "part"])

    def add(held: dict, name: object, part: np.ndarray) -> None:
        held[name] = _merge(held[name], part) if name in held else part

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)])
            seen = np.column_stack([np.asarray(batch.column(i + 1).is_valid()) for i in range(k)])
            names = np.unique(folds).tolist()
            for name in names:
                mine = folds == name
                add(held, name, _batch(x, seen) if len(names) == 1 else _batch(x[mine], seen[mine]))
        yield out(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                add(held, name, np.array(part).reshape(4, k, k))
        yield out(held)

    numbers = df.select(fold.cast("long").alias("_fold"), *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    rows = _together(numbers.mapInArrow(read, schema)).mapInArrow(join, schema).collect()
    held: dict = {}
    for row in sorted(rows, key=lambda r: (r["fold"], r["part"])):
        add(held, row["fold"], np.array(row["part"]).reshape(4, k, k))
    return held


def _together(parts: DataFrame) -> DataFrame:
    """The partials of all tasks in a few tasks, in one if they are small."""
    columns = parts.columns
    return parts.withColumn("_slot", F.spark_partition_id() % MERGERS).repartition("_slot").select(columns)


def triangle(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray]:
    """The number of complete rows, and the triangular factor of a column of ones and ``cols`` over them: with Q of
    orthonormal columns, (1, cols) = Q R. It holds all that least squares on any of the columns needs."""
    wide = len(cols) + 1
    schema = "n long, part array<double>"

    def reduced(x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(x, mode="r") if len(x) > wide else x

    def out(n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["n", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, wide))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
                n, r = n + len(x), reduced(np.vstack([r, reduced(x)]))
        if n:
            yield out(n, r)

    def merged(rows: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        """Two by two, in one order whatever task came first."""
        rows = sorted(rows, key=lambda row: (row[0], row[1].tolist()))
        while len(rows) > 1:
            rows = [(sum(n for n, _ in rows[i:i + 2]), reduced(np.vstack([r for _, r in rows[i:i + 2]]))) for i in range(0, len(rows), 2)]
        return rows[0] if rows else (0, np.zeros((0, wide)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held += [(n, np.array(part).reshape(-1, wide)) for n, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            held = [merged(held)] if len(held) > MERGERS else held
        if held:
            yield out(*merged(held))

    numbers = _complete(df, cols).select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    rows = _together(numbers.mapInArrow(read, schema)).mapInArrow(join, schema).collect()
    n, r = merged([(row["n"], np.array(row["part"]).reshape(-1, wide)) for row in rows])
    if not n:
        raise ValueError("no complete row")
    return n, r


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(cols))


def _from(part: np.ndarray) -> Moments:
    return Moments(int(part[0][0, 0]), np.diag(part[1]).copy(), (part[2] + part[2].T) / 2)


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """One pass over the complete rows."""
    held = _partials(_complete(df, cols), cols, F.lit(0))
    if not held or not held[0][0][0, 0]:
        raise ValueError("no complete row")
    return _from(held[0])


def fold_moments(df: DataFrame, cols: Sequence[str], fold: Column) -> list[Moments]:
    """Moments per fold, still one pass; rows without a fold are left out."""
    rows = _complete(df, cols).withColumn("_fold", fold).filter("_fold IS NOT NULL")
    held = _partials(rows, cols, F.col("_fold"))
    return [_from(held[name]) for name in sorted(held)]


def pair_moments(df: DataFrame, cols: Sequence[str]) -> PairMoments:
    """One pass over all rows; every pair counts where both columns are present."""
    # a column that is never missing counts the rows
    held = _partials(df.withColumn("_one", F.lit(1.0)), [*cols, "_one"], F.lit(0))
    k = len(cols)
    part = held.get(0, np.zeros((4, k + 1, k + 1)))
    return PairMoments(int(part[0][k, k]), *[p[:k, :k] for p in part])
