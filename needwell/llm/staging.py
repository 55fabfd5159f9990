"""Tables written once in the cluster's shared folder, so that later steps read them instead of working again."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="needwell-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one of our own."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of a frame, written and read back: lineage ends here and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/needwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
