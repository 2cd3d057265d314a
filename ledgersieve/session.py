"""Session settings the jobs expect.  A cluster's own session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM leaves methods above 8000 bytes uncompiled; wide profiles would run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording the Python line of every column expression costs more than the plans themselves.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | None = None, app: str = "ledgersieve") -> SparkSession:
    """A local session for tests and the benchmark."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SIEVE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
