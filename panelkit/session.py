"""Session-level helpers: where shared scratch data lives, and cutting lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for data that a job writes and reads back.

    It is the one ``spark.checkpoint.dir`` names. Where that is unset, a session in one process (``local[...]``) takes a
    new folder of its machine; any other takes one below ``spark.sql.warehouse.dir``, and refuses a warehouse on a local
    disk, since executors on other machines would not see what is written there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", None) or _default_folder(spark)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _default_folder(spark: SparkSession) -> str:
    if is_one_process(spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="panelkit-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return shared(full)


def is_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared(folder: str) -> str:
    """``folder``, unless only one machine can see it."""
    if folder.startswith(("file:", "/")):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; the default, {folder}, is on a local disk")
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for tables a job writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a finished scratch table; paths outside the shared folder are refused."""
    if not path.startswith(f"{checkpoint_dir(spark)}/"):
        raise ValueError(f"not a scratch path: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows of ``df`` to shared storage and read them back.

    Cuts the lineage with one computation, keeps columns prunable, and gives every later reader the same rows.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
