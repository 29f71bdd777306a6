"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int = 8, memory: str = "8g", partitions: int | None = None, **options: str) -> SparkSession:
    """A local session with the settings that the queries assume: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions or cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**settings, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
