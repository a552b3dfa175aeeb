"""Session settings that the engine expects; on a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(master).appName("loglattice").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
