"""Session construction with the settings every query assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "colloquy", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow. On a cluster leave `shuffle_partitions` unset and let the deployment decide."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local["):
        settings["spark.driver.memory"] = "8g"
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
