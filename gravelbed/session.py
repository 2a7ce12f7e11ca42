"""SparkSession factory used by tests, the benchmark and scripts."""

from __future__ import annotations

import os

from pyspark import SparkContext
from pyspark.sql import SparkSession


def _submitted() -> bool:
    """Whether spark-submit started this process: it hands its settings to the JVM that it has started already."""
    return "PYSPARK_GATEWAY_PORT" in os.environ


def get_session(cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """The session of the submitting environment, or a local one where none names a master."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder
    if not (os.environ.get("MASTER") or os.environ.get("SPARK_REMOTE") or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")) and SparkContext._active_spark_context is None and not _submitted():
        builder = builder.master(f"local[{cpus}]")
    spark = (
        builder.appName("gravelbed")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
