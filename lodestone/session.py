"""Session factory with the settings that every entry point of this library assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lodestone", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the submit configuration prevails.

    UTC keeps timestamps comparable with other engines; AQE coalesces small shuffles, splits skewed
    joins and turns small sides into broadcasts after measuring them.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
