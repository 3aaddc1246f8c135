"""SparkSession factory with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results, as opposed to speed.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_spark(app: str = "emberline", cpus: int | None = None, **conf: str) -> SparkSession:
    """Session for local use; on a cluster pass master and sizes through spark-submit."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EMBERLINE_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_semantics(spark: SparkSession) -> SparkSession:
    """Set the result-changing settings on a session that someone else made."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
