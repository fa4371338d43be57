"""Session with the settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "attesta", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; partitions are left to adaptive coalescing."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
