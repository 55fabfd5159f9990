"""Stored leads in folders by a hash bucket of their key: a batch reads and rewrites the buckets it touches.

Plain Parquet with a partition column, written by Spark's dynamic partition overwrite. Inside a bucket the
rows are sorted by key and carry Bloom filters of both keys, so a look-up by post URL opens one
folder, and one by id skips the row groups that do not have it. One writer at a time; a batch that
failed half way is applied again, which changes nothing where it had come through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from needwell import schemas
from needwell.operators import merge
from needwell.operators.store import read_or_empty
from needwell.session import staged

BUCKET = "bucket"
#: columns that are looked up by value
LOOKED_UP = (merge.KEY, "id")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(leads: DataFrame, path: str, buckets: int) -> None:
    """Write leads over the buckets that they have rows of; other buckets stay as they are."""
    placed = leads.withColumn(BUCKET, bucket_of(F.col(merge.KEY), buckets))
    writer = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, merge.KEY).write.mode("overwrite")
    for name in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All leads with the bucket they are in."""
    schema = StructType([*schemas.INTENT_LEADS.fields, StructField(BUCKET, IntegerType())])
    return read_or_empty(spark, path, schema, "parquet")


def upsert_buckets(spark: SparkSession, path: str, valid: DataFrame, now: Column, buckets: int) -> list[int]:
    """Apply a batch of valid rows; returns the buckets that were rewritten, at most ``buckets`` numbers.

    The batch is reduced per key once. The stored side is pruned to the touched buckets before it is read.
    """
    reduced = staged(merge.reduce_arrivals(valid).withColumn(BUCKET, bucket_of(F.col(merge.KEY), buckets)), "batch")
    touched = sorted(r[BUCKET] for r in reduced.select(BUCKET).distinct().collect())
    if touched:
        stored = read_buckets(spark, path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = merge.merge_arrivals(stored, reduced.drop(BUCKET), now)
        write_buckets(merged.drop("was_new", "arrivals", "first_need"), path, buckets)
    return touched


def lead_by_url(spark: SparkSession, path: str, post_url: str, buckets: int) -> DataFrame:
    """The lead of a post: one bucket is listed, and of it the row groups that can have the URL are read."""
    url = F.lit(post_url)
    return read_buckets(spark, path).where((F.col(BUCKET) == bucket_of(url, buckets)) & (F.col(merge.KEY) == url)).drop(BUCKET)


def lead_by_id(spark: SparkSession, path: str, ident: str) -> DataFrame:
    """The lead of an id: row groups whose Bloom filter excludes it are skipped."""
    return read_buckets(spark, path).where(F.col("id") == ident).drop(BUCKET)
