"""Spark session with the settings this engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "velith", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings of the cluster or of ``more`` win.

    Partition numbers are left to the cluster and to adaptive execution: nothing here depends on their value.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**wanted, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
