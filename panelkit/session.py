"""A session with the settings that the panel operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "panelkit", **conf: str) -> SparkSession:
    """ANSI on, UTC, adaptive execution with skew joins, Arrow, checkpoints removed with their tables; conf adds or replaces settings (dots as __)."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
