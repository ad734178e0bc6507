"""Wide daily files as a Spark data source: long rows, one per id and date, straight from the files.

A wide file has a few id columns and one column per date. ``spark.read.format("wide_panel")`` plans partitions by file, many
small files or a byte range of a large one each; every task reads the headers of its own files, so files of a folder may have
different columns in any order and the driver opens none. The reader takes over conditions on ids and dates: files without a
wanted date are not parsed further, unwanted date columns are never converted, unwanted rows never become long. They are given
as arguments, or come from Spark's planner with ``push``; Spark 4.1 keeps what the planner pushed with the loaded relation, so
a frame loaded with ``push`` must be used in one query only.

Paths are those Arrow's file systems know (local, hdfs, s3, gs); ``read_wide`` reads through Spark's own.
"""

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
import datetime as dt
import fnmatch
import json
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "wide_panel"
#: Bytes of one partition, what opening a file counts for, and cells of one batch of long rows.
PARTITION, OPENING, CELLS = 32 << 20, 1 << 20, 1 << 17


@dataclass
class Slices(ds.InputPartition):
    """Parts ``(file, first byte, end)`` of files; lines belong to the part they begin in."""

    parts: list[tuple[str, int, int]]

    def __post_init__(self):
        self.value = None


def _compare(kind: type) -> Callable[[object, object], bool] | None:
    return {ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b,
            ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b,
            ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b),
            ds.StringContains: lambda a, b: b in a}.get(kind)


class WideReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], ids: list[str]):
        self.path, self.ids = options["path"], ids
        self.date_format = options.get("dateformat", "%Y-%m-%d")
        self.glob, self.separator = options.get("glob", "*"), options.get("sep", ",")
        self.size = int(options.get("partitionbytes", PARTITION))
        self.filters: list[tuple[str, ds.Filter]] = [
            (c, ds.In((c,), tuple(values))) for c, values in json.loads(options.get("where", "{}")).items()]
        for bound, kind in (("first", ds.GreaterThanOrEqual), ("last", ds.LessThanOrEqual)):
            if bound in options:
                self.filters.append(("date", kind(("date",), dt.date.fromisoformat(options[bound]))))

    def _fits(self, column: str, value: object) -> bool:
        for name, one in self.filters:
            if name == column:
                if value is None:
                    return False
                if not isinstance(one, ds.IsNotNull) and not _compare(type(one))(value, one.value):
                    return False
        return True

    def partitions(self) -> Sequence[Slices]:
        files, root = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
        info = files.get_file_info(root)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pa.fs.FileType.File else files.get_file_info(pa.fs.FileSelector(root, recursive=True))
        # files that begin with a dot or an underscore are not data, as in Spark's own readers
        found = sorted((f.path, f.size) for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_"))
                       and fnmatch.fnmatch(f.base_name, self.glob) and f.size)
        out, held, load = [], [], 0
        for path, size in found:
            packed = path.endswith((".gz", ".bz2", ".zst"))
            for first in range(0, size, size if packed else self.size):
                end = size if packed else min(size, first + self.size)
                if held and load + end - first + OPENING > self.size:
                    out.append(Slices(held))
                    held, load = [], 0
                held.append((path, first, end))
                load += end - first + OPENING
        return [*out, Slices(held)] if held or not out else out

    def _table(self, files: pa.fs.FileSystem, path: str, first: int, end: int) -> tuple[pa.Table, list[tuple[dt.date, str]]] | None:
        """The lines of a part that begin in it, ids and wanted dates only, and these dates with their columns."""
        if path.endswith((".gz", ".bz2", ".zst")):
            with files.open_input_stream(path) as source:  # unpacked on the way
                header, data = _first_line(source.read())
        else:
            with files.open_input_file(path) as source:
                head = b""
                while True:  # a header may be long: one column a day
                    more = source.read(1 << 16)
                    head += more
                    if not more or head.lstrip(b"\r\n\t \xef\xbb\xbf").find(b"\n") >= 0:
                        break
                header, _ = _first_line(head)
                line = head.find(b"\n", head.find(header) if header else len(head))
                body = line + 1 if line >= 0 else len(head)
                start = max(first, body)
                if not header or start >= end:
                    return None
                source.seek(start - 1)
                data = source.read(end - start + 1)
                # behind the header a line begins here; elsewhere behind the next line break, which may be the byte before
                cut = 0 if start == body else data.find(b"\n")
                data = data[cut + 1:] if cut >= 0 else b""
                while data and not data.endswith(b"\n"):  # to the end of the last line
                    more = source.read(1 << 16)
                    cut = more.find(b"\n")
                    data += more if cut < 0 else more[:cut + 1]
                    if not more:
                        break
        if not header.strip():
            return None
        names = next(iter(pa.csv.read_csv(pa.BufferReader(header.lstrip(b"\xef\xbb\xbf") + b"\n"), read_options=pa.csv.ReadOptions(autogenerate_column_names=True),
                                          parse_options=pa.csv.ParseOptions(delimiter=self.separator),
                                          convert_options=pa.csv.ConvertOptions(column_types={f"f{i}": pa.string() for i in range(header.count(self.separator.encode()) + 1)})).to_pylist())).values()
        names = [n or "" for n in names]
        missing = [c for c in self.ids if c not in names]
        if missing:
            raise ValueError(f"id columns not in {path}: {missing}")
        dates = []
        for name in names:
            try:
                day = dt.datetime.strptime(name, self.date_format).date()
            except ValueError:
                continue  # neither an id nor a date
            if self._fits("date", day):
                dates.append((day, name))
        if not dates or not data.strip():
            return None
        wanted = [*self.ids, *[name for _, name in dates]]
        table = pa.csv.read_csv(
            pa.BufferReader(data), read_options=pa.csv.ReadOptions(column_names=names, block_size=max(1 << 20, min(len(data), 1 << 30))),
            parse_options=pa.csv.ParseOptions(delimiter=self.separator),
            convert_options=pa.csv.ConvertOptions(include_columns=wanted, column_types={c: pa.string() for c in wanted}, strings_can_be_null=True,
                                                  null_values=[""], quoted_strings_can_be_null=True))
        return table, dates

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        files = (pa.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pa.fs.LocalFileSystem())
        for path, first, end in partition.parts:
            found = self._table(files, path, first, end)
            if found is None:
                continue
            table, dates = found
            for name in {name for name, _ in self.filters if name != "date"}:
                own = table[name].unique().to_pylist()
                fine = pa.array([v for v in own if self._fits(name, v)], pa.string())
                table = table.filter(pc.is_in(table[name], value_set=fine))
            step = max(1, CELLS // len(dates))
            for at in range(0, table.num_rows, step):
                part = table.slice(at, step).combine_chunks()
                n = part.num_rows
                turn = pa.array(np.tile(np.arange(n), len(dates)))
                arrays = [_flat(part[c]).take(turn) for c in self.ids]
                arrays.append(pa.array([d for d, _ in dates], pa.date32()).take(pa.array(np.repeat(np.arange(len(dates)), n))))
                arrays.append(pa.concat_arrays([_flat(part[name]) for _, name in dates]))
                yield pa.RecordBatch.from_arrays(arrays, [*self.ids, "date", "value"])


class PushedWideReader(WideReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Conditions on one id or the date are taken over whole; the rest, such as those on values, stay with Spark."""
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if column == "date" and isinstance(one, ds.IsNotNull):
                continue  # every row has a date
            if (column in self.ids and (_compare(type(one)) or isinstance(one, ds.IsNotNull))) or (
                    column == "date" and _compare(type(one)) and not isinstance(one, (ds.StringStartsWith, ds.StringEndsWith, ds.StringContains))):
                self.filters.append((column, one))
            else:
                yield one


def _flat(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def _first_line(data: bytes) -> tuple[bytes, bytes]:
    """The first line that is not blank, and what follows it."""
    while data:
        line, _, data = data.partition(b"\n")
        if line.strip(b"\r\t \xef\xbb\xbf"):
            return line.rstrip(b"\r"), data
    return b"", b""


class WidePanel(ds.DataSource):
    """``spark.read.format("wide_panel")`` with the options ``path``, ``ids`` (names, separated by semicolons), ``dateFormat``
    (Python's), ``where`` (JSON: an id's wanted values), ``first`` and ``last`` (dates), ``glob``, ``sep`` and
    ``partitionBytes``. Columns: the ids, ``date``, and ``value``, the cell's text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _ids(self) -> list[str]:
        return self.options["ids"].split(";")

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self._ids()) + ", `date` date, `value` string"

    def reader(self, schema) -> WideReader:
        return WideReader({k.lower(): v for k, v in self.options.items()}, self._ids())


class PushedWidePanel(WidePanel):
    """The same, which also takes over conditions from Spark's planner."""

    @classmethod
    def name(cls) -> str:
        return f"{NAME}_pushed"

    def reader(self, schema) -> PushedWideReader:
        return PushedWideReader({k.lower(): v for k, v in self.options.items()}, self._ids())


def read_wide_panel(spark: SparkSession, path: str, ids: Sequence[str], where: Mapping[str, Sequence[str]] | None = None,
                    first: dt.date | None = None, last: dt.date | None = None, date_format: str = "%Y-%m-%d", push: bool = False,
                    **options) -> DataFrame:
    """Long rows ``(ids, date, value)`` of all wide files below ``path``; cells are text, empty ones NULL.

    ``where`` lists the wanted values of ids, ``first`` and ``last`` bound the dates; with ``push`` filters on the frame are read
    off its plan too, for one query. A column whose name is neither an id nor a date is left out. A file without an id column
    raises; blank and empty files have no rows. Cells hold no line breaks.
    """
    unknown = [c for c in where or {} if c not in ids]
    if unknown:
        raise ValueError(f"no id columns: {unknown}")
    kind = PushedWidePanel if push else WidePanel
    spark.dataSource.register(kind)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {"path": path, "ids": ";".join(ids), "dateFormat": date_format, "where": json.dumps({c: list(v) for c, v in (where or {}).items()}),
             **{k: d.isoformat() for k, d in (("first", first), ("last", last)) if d is not None}, **options}
    reader = spark.read.format(kind.name())
    for name, value in given.items():
        reader = reader.option(name, value)
    return reader.load()
