"""Embedding whitening: the leading components of the covariance by contour integration (FEAST), and vectors scaled by them.

Spark makes the list of distinct lattice vectors, their exact sums and, in a second pass, their centred products; what is
left is a matrix as wide as one vector. Inertia counts (the signs of a factorisation of V - s) place the intervals that hold
the wanted eigenvalues. On each, a quadrature of solves with V shifted into the complex plane projects random vectors onto
the interval's eigenspace, and a Rayleigh-Ritz step on the projected vectors gives the eigenpairs; both are repeated until
the residuals vanish and as many pairs are found as the inertia counts say. Counts and solves are Spark tasks, one a shift.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelkit.llm.common import ship
from panelkit.session import settle

COMPONENTS = 16
#: The lattice: a whole number of steps, and an offset that keeps entries above zero.
STEPS, OFFSET = 64, 1_000_000
#: Entries beyond this count as this; their lattice numbers would leave the range of a long.
LARGEST = float(1 << 45)
#: Points on half a contour, shifts of one round of inertia counts, eigenvalues an interval is meant to hold, rounds of
#: projection, and the least eigenvalue (as a share of their sum) that counts as more than rounding.
POINTS, SHIFTS, SLICE, ROUNDS, LEAST = 12, 15, 12, 60, 1e-12


def lattice(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, x)``: each usable vector with its entries c as floor(64 c) + 1000000.

    Vectors that are null, empty, or hold a null, NaN or infinity are left out, as are those of another length than the
    commonest (of equally common ones the longest): they have no place in one covariance.
    """
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = df.select(F.col(key), v.alias("v")).filter(fine)
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    bounded = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c))
    x = F.transform("v", lambda c: F.floor(F.lit(float(STEPS)) * bounded(c)) + F.lit(OFFSET).cast("long"))
    return rows.filter(F.size("v") == (width["width"] if width else 0)).select(key, x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums, one for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + _matrix(batch).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(total) + 1), "value": np.append(total, n)})

    ship(fit.sparkSession)
    rows = fit.mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = [int(r["value"]) for r in sorted(rows, key=lambda r: r["place"])]  # one number for each dimension
    return (found[-1], found[:-1]) if found else (0, [])


def centred(n: int, total: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Subtracts the mean: first its whole part, exactly, then the rest."""
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    return lambda x: (x - whole) - rest


def products(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of the outer product of ``work`` of them with itself.

    Each task multiplies whole batches; rows of the partial matrices are added up where their number sends them, so the
    driver gets one matrix, as wide as a vector."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = work(_matrix(batch))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(total)), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, row in zip(batch.column("place").to_pylist(), batch.column("row")):
                row = row.values.to_numpy()
                total[place] = total[place] + row if place in total else row
        if total:
            yield pa.RecordBatch.from_pydict({"place": list(total), "row": pa.array(list(total.values()), pa.list_(pa.float64()))})

    schema = "place long, row array<double>"
    rows = fit.mapInArrow(part, schema).repartition("place").mapInArrow(merged, schema).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["place"])])


# ---------------------------------------------------------------- eigenvalues in an interval

def inertia(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` lie above ``shift``: the positive ones of a block diagonal matrix that
    V - shift is congruent to. Pivots are of one row, or of two where no diagonal entry is large enough."""
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).eps * max(np.abs(v).max(initial=0), abs(shift))
    above = 0
    while len(a):
        size = np.abs(a)
        one = int(np.argmax(size.diagonal()))
        p, q = np.unravel_index(int(np.argmax(size)), a.shape)
        if size[p, q] <= tiny:
            break  # what is left has the eigenvalue ``shift``, which is not above it
        pivot = [one] if size[one, one] >= 0.64 * size[p, q] else [int(p), int(q)]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        block = a[np.ix_(pivot, pivot)]
        above += int((np.linalg.eigvalsh(block) > 0).sum()) if len(pivot) > 1 else int(block[0, 0] > 0)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return above


def contour(low: float, high: float, points: int = POINTS) -> list[tuple[complex, complex]]:
    """Shifts and weights of Gauss-Legendre quadrature on the upper half of the circle through ``low`` and ``high``."""
    at, weight = np.polynomial.legendre.leggauss(points)
    turn = np.exp(0.5j * np.pi * (1 + at))
    radius = (high - low) / 2
    return [(complex((low + high) / 2 + radius * t), complex(0.5 * w * radius * t)) for t, w in zip(turn, weight)]


def solved(v: np.ndarray, shift: complex, weight: complex, start: np.ndarray) -> np.ndarray:
    """One point's share of the projection of ``start`` onto the eigenvectors inside the contour."""
    return (weight * np.linalg.solve(shift * np.eye(len(v)) - v, start.astype(complex))).real


def rayleigh_ritz(v: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of ``v`` within the space that the columns of ``span`` span."""
    left, size, _ = np.linalg.svd(span, full_matrices=False)
    q = left[:, size > 1e-13 * size.max(initial=0)]
    value, vector = np.linalg.eigh(q.T @ v @ q)
    return value[::-1], (q @ vector)[:, ::-1]


def _tasks(spark: SparkSession, many: int, work: Callable[[int], np.ndarray]) -> list[np.ndarray]:
    """``work(i)`` for i from 0 to ``many`` - 1, each in a task of its own; the results are no larger than the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                out = np.ascontiguousarray(work(i), np.float64)
                yield pa.RecordBatch.from_pydict({"id": [i], "shape": [list(out.shape)], "data": pa.array([out.tobytes()], pa.binary())})

    rows = spark.range(0, many, 1, many).mapInArrow(run, "id long, shape array<long>, data binary").collect()
    return [np.frombuffer(bytes(r["data"])).reshape(r["shape"]) for r in sorted(rows, key=lambda r: r["id"])]


@dataclass
class Interval:
    """Eigenvalues from ``low`` (not included) to ``high``: how many there are, and vectors that come closer to their space."""

    low: float
    high: float
    count: int
    span: np.ndarray


def intervals(counts: Callable[[list[float]], list[int]], top: float, floor: float, wanted: int) -> tuple[list[tuple[float, float, int]], int]:
    """``(low, high, count)`` from the highest down, which hold the ``wanted`` largest eigenvalues, or all above ``floor`` if there
    are fewer; and how many are wanted then. ``counts`` gives the eigenvalues above each of some shifts.

    Rounds of evenly spaced shifts close in on the last wanted eigenvalue until no more than ``SLICE`` others come with it, or
    until the shifts lie as close as rounding lets them tell apart (ties, which then come together)."""
    known = {top: 0, floor: counts([floor])[0]}
    wanted = min(wanted, known[floor])
    low, high = floor, top
    while wanted and known[low] > wanted + SLICE and high - low > 1e-9 * top:
        shifts = [low + (high - low) * i / (SHIFTS + 1) for i in range(1, SHIFTS + 1)]
        known |= dict(zip(shifts, counts(shifts)))
        low = max(s for s in known if known[s] >= wanted)
        high = min(s for s in known if known[s] < wanted)
    out, edge = [], top
    bounds = sorted((s for s in known if s >= low), reverse=True)
    for at, after in zip(bounds[1:], [*bounds[2:], None]):
        # an interval ends before it would hold too many, and at the end
        if after is None or known[after] - known[edge] > SLICE:
            if known[at] > known[edge]:
                out.append((at, edge, known[at] - known[edge]))
            edge = at
    return (out if wanted else []), wanted


def leading(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the symmetric, non-negative ``v``, falling, and their unit eigenvectors as columns; fewer
    than ``wanted`` if the others are zero up to rounding."""
    d = len(v)
    trace = float(np.trace(v)) if d else 0.0
    if trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    matrix = spark.sparkContext.broadcast(v)  # as wide as a vector
    counts = lambda shifts: [int(c[0]) for c in _tasks(spark, len(shifts), lambda i: np.array([inertia(matrix.value, shifts[i])]))]
    top = float(min(np.abs(v).sum(axis=1).max(), trace)) * (1 + 1e-9)  # no eigenvalue is above
    slices, wanted = intervals(counts, top, LEAST * trace, wanted)
    rng = np.random.default_rng(seed)
    open_ = [Interval(a, b, n, rng.normal(size=(d, min(d, n + max(n // 2, 8))))) for a, b, n in slices]
    found: list[np.ndarray] = []
    for turn in range(ROUNDS):
        if not open_:
            break
        work = [(i, z, w) for i, one in enumerate(open_) for z, w in contour(one.low, one.high)]
        spans = spark.sparkContext.broadcast([one.span for one in open_])
        shares = _tasks(spark, len(work), lambda k: solved(matrix.value, work[k][1], work[k][2], spans.value[work[k][0]]))
        still = []
        for i, one in enumerate(open_):
            value, vector = rayleigh_ritz(v, sum(s for s, (j, _, _) in zip(shares, work) if i == j))
            inside = (value > one.low) & (value <= one.high)
            rest = np.linalg.norm(v @ vector[:, inside] - vector[:, inside] * value[inside], axis=0).max(initial=0)
            if inside.sum() == one.count and rest <= 1e-13 * top * np.sqrt(d):
                found.append(vector[:, inside])
                continue
            if inside.sum() != one.count and turn % 10 == 9:  # too small a space
                vector = np.hstack([vector, rng.normal(size=(d, min(d - vector.shape[1], one.count)))])
            still.append(Interval(one.low, one.high, one.count, vector))
        open_ = still
    if open_:
        raise RuntimeError(f"no convergence on {[(one.low, one.high, one.count) for one in open_]}")
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    value, vector = rayleigh_ritz(v, np.hstack(found))  # makes vectors of different intervals orthogonal to the last digit
    if len(value) != sum(n for _, _, n in slices):
        raise RuntimeError("components of different intervals coincide")
    return value[:wanted], vector[:, :wanted]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    ``n`` is the number of distinct lattice vectors, the fit list; the covariance has the divisor n. ``deviation`` is the exact
    sum of (n x - S)^2, null where that is beyond a long; ``whitened`` the centred vector's share of the component over the
    root of its eigenvalue; ``explained`` that eigenvalue over their sum; ``identity_error`` the largest entry of the whitened
    fit list's covariance minus the identity. Components without any spread have no rows; an empty table has none at all.
    Repeated rows and keys come out as often as they go in; null keys are kept.
    """
    spark = df.sparkSession
    rows = lattice(df, key, vector)
    schema = StructType([df.schema[key]] + StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    fit = settle(rows.select("x").distinct())
    n, total = sums(fit)
    if not n:
        return spark.createDataFrame([], schema)
    centre = centred(n, total)
    v = products(fit, centre) / n
    v = (v + v.T) / 2
    value, vector_ = leading(spark, v, components)
    scale = vector_ / np.sqrt(value)
    trace = float(np.trace(v))
    k = len(value)
    if not k:
        return spark.createDataFrame([], schema)
    ones = products(fit, lambda x: np.hstack([centre(x) @ scale, np.ones((len(x), 1))])) / n
    error = float(np.abs(ones[:k, :k] - np.outer(ones[:k, k], ones[:k, k]) - np.eye(k)).max())
    arrow = to_arrow_schema(schema)
    s = np.array(total, object)
    narrow = n * max(map(abs, total)) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                part = batch.slice(first, 8192)
                x = _matrix(part)
                y = centre(x) @ scale
                m = len(x)
                # whole numbers throughout: in 64 bits where those hold every step, else in Python's
                far = float(n) * float(np.abs(centre(x)).max()) + 1
                if narrow and float(n) * float(np.abs(x).max()) < 2 ** 62 and far * far * x.shape[1] < 2 ** 62:
                    apart = ((n * x - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    apart = [z if z < 1 << 63 else None for z in ((n * x.astype(object) - s) ** 2).sum(axis=1)]
                again = pa.array(np.repeat(np.arange(m), k))
                arrays = [part.column(key).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                          pa.array(apart, pa.int64()).take(again), pa.array(y.ravel()), pa.array(np.tile(value / trace, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)
