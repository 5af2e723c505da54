"""Session settings shared by queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; extra settings override the defaults."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    builder = SparkSession.builder.master(master).appName("siftwright")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
