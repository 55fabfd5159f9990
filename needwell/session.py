"""Session helpers: semantic settings only, sizing stays with the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "needwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and the settings the stages rely on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # long texts: keep Arrow batches small enough for a Python worker
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: naive timestamps mean UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="needwell-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a private one only for a session on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
    return _own_dir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of a frame, written to the shared folder and read back: they are worked out once."""
    path = f"{shared_dir(df.sparkSession)}/needwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rounds: int = 1) -> DataFrame:
    """Rows over all cores when the scan has fewer splits than there are cores, times ``rounds``.

    Text stages are bound by CPU, and a file of one row group is one split. Large
    inputs have more splits than cores and pass through without a shuffle.
    """
    tasks = rounds * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *keys) if df.rdd.getNumPartitions() < tasks else df
