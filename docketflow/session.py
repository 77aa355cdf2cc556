"""The session the library's examples, tests and bench use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "docketflow", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings every job assumes: UTC, AQE, RocksDB state."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()
