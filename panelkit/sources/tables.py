"""Table sources and sinks."""

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

TEXT_SEPARATORS = {".csv": ",", ".tsv": "\t"}


def _strip_mark(df: DataFrame) -> DataFrame:
    """Remove a byte-order mark that an exporter left in front of the first column name."""
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text (by file ending) or Parquet. Without a schema, text types are inferred."""
    for ending, sep in TEXT_SEPARATORS.items():
        if path.rstrip("/").endswith(ending):
            reader = spark.read.option("header", True).option("sep", sep)
            if schema is None:
                return _strip_mark(reader.option("inferSchema", True).csv(path))
            # columns are taken by place, so a header in another order must fail
            return reader.schema(schema).option("enforceSchema", False).csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their first line that is not blank; those without one are left out. The lines are read in tasks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("place"), "value").filter(F.trim("value") != "")
    # a file's parts lie in order within the numbers of their tasks only; its first line is in the part that begins it
    firsts = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "place")).alias("header"))
    found: dict[str, list[str]] = {}
    for header, files in sorted(firsts.groupBy("header").agg(F.sort_array(F.collect_list("file"))).collect()):
        found[header] = files
    return found


def read_wide(spark: SparkSession, path: str, id_cols: Sequence[str]) -> DataFrame:
    """A wide table of unknown width: every column arrives as text, the named ids come first.

    Counts stay text because some cells carry thousands commas; ``clean_number`` repairs them. Files of a folder may have
    different columns or another order: those with one header are read together, and columns meet by name.
    """
    files = _headers(spark, path)  # a file without a header has no rows
    reader = spark.read.option("header", True)
    if len(files) < 2:
        df = _strip_mark(reader.csv(path))
    else:
        groups = sorted(files.items(), key=lambda item: (-item[0].count(","), item[0]))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_strip_mark(reader.csv(f)) for _, f in groups])
    missing = [c for c in id_cols if c not in df.columns]
    if missing:
        raise ValueError(f"id columns not in the file: {missing}")
    rest = [c for c in df.columns if c not in id_cols]
    return df.select(*[F.col(f"`{c}`") for c in [*id_cols, *rest]])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite ``path``. Text files keep their header line."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table written down in the program (state names, marker positions, display names).

    Built from Arrow it is a local relation: its size is known, so the optimizer can broadcast it.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = [pa.array([row[i] for row in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)
