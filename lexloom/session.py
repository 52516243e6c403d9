"""Session for tests and benchmarks; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, in UTC."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexloom")
        .config("spark.driver.memory", os.environ.get("LEXLOOM_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """The Parquet table `name` of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and all executors share: below `spark.checkpoint.dir`, or local in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(told or 'file://' + tempfile.mkdtemp(prefix='lexloom-')).rstrip('/')}/lexloom/{name}-{uuid.uuid4().hex}"
