"""What several operators share: flat text buffers, stable splits, and reads of the given tables."""

from collections.abc import Callable, Iterator
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text one step of a batch operator holds at a time; a single longer text is a step of its own.
STEP_BYTES = 4 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that they can import it wherever they are."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = os.path.realpath(tempfile.mkdtemp(prefix="panelkit-source-"))  # the driver serves it for as long as it runs
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "panelkit"), "zip", root, "panelkit"))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(c: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column one after another, and the ``n + 1`` offsets; a null text is empty."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(offsets) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def flat_bytes(values: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after another; a copy, so that it can be viewed as words."""
    values = pc.cast(values, pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].copy()


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one step hold about ``size`` bytes, so memory does not follow the text length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            seen = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, seen + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """``keep`` of the batch beside the computed columns."""
    arrays = [batch.column(c) for c in keep] + [v if isinstance(v, pa.Array) else pa.array(v) for v in new.values()]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def map_texts(df: DataFrame, text: str, keep: list[str], added: str,
              work: Callable[[pa.RecordBatch], dict[str, object]], size: int = STEP_BYTES) -> DataFrame:
    """Columns ``added`` (a DDL string), computed by ``work`` from steps of rows with about ``size`` bytes of text, beside the
    columns ``keep``.

    Rows stay in their partition; only ``keep`` and the text reach Python.
    """
    ship(df.sparkSession)
    kept = T.StructType([df.schema[c] for c in keep])
    out = T.StructType(kept.fields + T.StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, size):
            yield with_columns(batch, keep, work(batch), arrow)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, out)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset (end included) the number of code points before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
