"""Time the headline queries, warm, and print one JSON line: the median of three runs of each.

The tables are copied once, outside the timing, to as many files as there are cores: as single files of
one row group they would be read, and all extraction done, by one task.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evalloom.operators import accuracy as acc
from evalloom.operators import evaluate as ev
from evalloom.plans import fixtures as fx
from evalloom.plans import registry

# Extraction and scoring of every dialect, accuracy tables, folds, rewards, sampling.
HEADLINE = [
    "agg1", "agg3", "agg6", "agg7", "agg10", "agg21", "agg27", "jn1", "jn10", "sco5", "sco8",
    "fld2", "fld3", "fld5", "fld9", "fld_all", "rwd5", "dia6", "win1", "win2", "jn11", "gen6", "key1",
]

TABLES = ["customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "region", "nation"]


def line_results(spark: SparkSession, sf_dir: str):
    """Answers on every line item: the largest table, scored and summed up per task."""
    pred = (F.col("l_partkey") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)) % 10
    rows = fx.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("task_name"),
        (F.col("l_partkey") % 10).cast("string").alias("ground_truth"),
        F.lit("integer").alias("parser"), F.lit("integer_distance").alias("scorer"),
        F.concat(F.lit("The answer is {"), pred.cast("string"), F.lit("}")).alias("raw_response"),
    )
    return acc.accuracy_summary(ev.evaluate(rows))


def spread(spark: SparkSession, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` files each; returns its folder."""
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # one machine: driver and tasks share it
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: registry.QUERIES[name] for name in HEADLINE} | {"line_results": line_results}
    name_of_size, sf_dir = sf_dir.rsplit("sf", 1)[-1], spread(spark, sf_dir, int(cpus))
    times = {}
    for name, build in runs.items():
        spent = []
        for _ in range(4):  # the first run compiles code and is not counted
            start = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": name_of_size,
            }
        )
    )


if __name__ == "__main__":
    main()
