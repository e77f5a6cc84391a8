"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "seqloom", master: str | None = None, **options: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC; ``options`` replace ``__`` by a dot."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in options.items()}
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
