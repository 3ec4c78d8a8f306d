"""SparkSession factory with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "cellweave", cpus: int | str = "*", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster pass the session that the cluster gives."""
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": os.environ.get("CELLWEAVE_SHUFFLE", "8"),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("CELLWEAVE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | (extra or {})
    builder = SparkSession.builder.appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
