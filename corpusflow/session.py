"""A session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corpusflow", **options: str) -> SparkSession:
    """UTC, adaptive plans with skew joins, Arrow. Cluster settings such as spark.checkpoint.dir stay as they are."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
