"""Weekly sums over a stream of dated records."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelkit.session import scratch_path

# 1970-01-04 was a Sunday, so weeks shifted by three days start on Sundays (session time zone UTC).
WEEK, SUNDAY = "7 days", "3 days"


def stream_weekly(stream_df: DataFrame, ts: str = "ts", key: str = "state", value: str = "new_cases") -> DataFrame:
    """Sum per Sunday week and key. Late records count however late they are, so the state holds one sum per week and key,
    as many as the calendar has."""
    weeks = (stream_df.withColumn(ts, F.col(ts).cast("timestamp"))
             .groupBy(F.window(ts, WEEK, WEEK, SUNDAY), key)
             .agg(F.sum(value).alias("state_new_cases")))
    return weeks.select(F.col("window.start").cast("date").alias("week"), key, "state_new_cases")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished tables below ``path``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().removeprefix("version-")) for f in found or [])


def latest_weekly(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest finished table below ``path``; an empty one if there is none yet."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version-{versions[-1]}")


def run_weekly(weeks: DataFrame, path: str | None = None, progress: str | None = None) -> DataFrame:
    """Run a weekly stream over all data that is there and return the newest table it wrote.

    Every batch writes the current sums as a new version below ``path``, visible once it is finished; a repeated batch
    writes its own version again, and only the one before is kept besides. With the same ``path`` and ``progress`` folders a
    later run goes on where this one stopped.
    """
    spark = weeks.sparkSession
    path = path or scratch_path(spark, "weekly")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version-{number}")
        for old in _versions(spark, path)[:-2]:
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-{old}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    query = (weeks.writeStream.outputMode("complete").foreachBatch(write)
             .option("checkpointLocation", progress or scratch_path(spark, "weekly-progress"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return latest_weekly(spark, path, weeks.schema)
