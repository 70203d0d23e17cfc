"""Session construction and input loading shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "chartmill", scratch: str | None = None) -> SparkSession:
    """A local session for tests and the bench, with its scratch folder; clusters bring their own."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return (
        builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(8, n)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
