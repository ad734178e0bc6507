"""Time the headline queries: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelkit.operators import ols  # noqa: E402
from panelkit.queries import QUERIES  # noqa: E402

HEADLINES = [
    "latest_weekly_rate", "built_panel", "built_snapshot", "daily_panel", "weekly_bulletins", "daily_bulletin", "map_layer",
    "tidy_census_table", "feature_master", "subset_shares", "subset_lattice", "category_share_list", "line_shares_of_part",
    "ordered_levels", "city_report", "price_summary", "price_outliers", "correlation_test", "correlation_matrix",
    "rank_correlation", "rank_correlation_prices", "price_by_priority_anova", "two_predictor_regression", "lasso_terms",
    "stepwise_terms", "top_customers", "page_links", "streamed_weeks",
]


def wide_regression(spark: SparkSession, folder: str):
    """Least squares with 34 predictors, the width of the feature master, over all lines."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    base = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    made = [F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(i)), F.lit(1000)).cast("double").alias(f"x{i}") for i in range(30)]
    return ols(lines.select("l_extendedprice", *base, *made), "l_extendedprice", [*base, *[f"x{i}" for i in range(30)]])


EXTRA = {"wide_regression": wide_regression}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("panelkit-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("orders_by_status", "built_panel", "simple_regression"):  # start the engine and its workers before the clock
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    runs = QUERIES | EXTRA
    names = sys.argv[1:] or [*HEADLINES, *EXTRA]
    seconds = {}
    for name in names:
        start = time.perf_counter()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
