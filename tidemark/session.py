"""The Spark session of the jobs and tools."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str, *, master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` takes further settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
