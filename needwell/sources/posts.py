"""Raw post tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell import schemas


def read_raw_posts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw posts in the declared schema (``parquet``, ``json`` or any Spark format)."""
    return spark.read.schema(schemas.RAW_POSTS).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved pages with their URL."""
    return spark.read.schema(schemas.PAGES).format(fmt).load(path)


def enabled_sources(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only rows of sources that the configuration enables."""
    wanted = [n.strip() for n in names if n.strip()]
    return df.where(F.col("source").isin(*wanted)) if wanted else df.where(F.lit(False))
