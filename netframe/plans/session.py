"""Session set-up and a description of the engine."""

from __future__ import annotations

import platform

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "netframe", **conf: str) -> SparkSession:
    """A session with adaptive execution; master is left to the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def engine_info(spark: SparkSession) -> dict:
    sc = spark.sparkContext
    return {
        "python": platform.python_version(),
        "system": platform.platform(),
        "spark": spark.version,
        "master": sc.master,
        "parallelism": sc.defaultParallelism,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled") == "true",
    }
