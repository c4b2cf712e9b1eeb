"""Session builder with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session: adaptive execution, UTC, Arrow transfer; ``conf`` names use _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
