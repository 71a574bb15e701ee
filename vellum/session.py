"""A session with the settings that the pipelines assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "vellum", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; further settings by keyword with ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in {**own, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
