"""Session settings shared by tests, bench and entry point."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Broadcasts are decided by Spark from statistics, up to this size. Only tables whose
# size is fixed by the code (rules, endings, manifest) carry an explicit hint.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "stichos") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("STICHOS_DRIVER_MEMORY", "12g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
