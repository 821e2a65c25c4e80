"""A session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ranklake", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution on, UTC; partition counts are left to the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | settings
    return builder.config(map=conf).getOrCreate()
