"""Session factory and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` keys use ``__`` for a dot.

    Master, partitions and memory are the cluster's to say and are set only if asked for;
    started by plain Python without a master, a session runs on this machine.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is None and "PYSPARK_GATEWAY_PORT" not in os.environ and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and not SparkSession.getActiveSession():
        master = "local[*]"
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # one machine: no shuffle needs more partitions than it has slots, and the driver does the work
            slots = "".join(c for c in master.split(",")[0] if c.isdigit()) or str(os.cpu_count() or 1)
            builder = builder.config("spark.sql.shuffle.partitions", slots).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
