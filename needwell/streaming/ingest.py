"""Streams of posts and attempts, file by file, into tables.

A micro-batch is known by its feed and number; whatever order files arrive in, none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from needwell import schemas
from needwell.operators import store
from needwell.operators.runs import requests_per_day


def read_posts(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.RAW_POSTS,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Raw posts from files as they arrive."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def feed_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the feed that a checkpoint belongs to: survives restarts, new with each new checkpoint."""
    return spark.read.schema("id STRING").json(f"{checkpoint}/metadata").first()["id"]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed_state(spark: SparkSession) -> None:
    """State of streams on the executors' disks, with their changes in the checkpoint: it may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _start(
    rows: DataFrame,
    checkpoint: str,
    apply: Callable[[DataFrame, str], None],
    available_now: bool,
    interval: str,
    mode: str = "append",
) -> StreamingQuery:
    """Hand every micro-batch to ``apply``, with an id that no other feed or batch has."""

    def each(batch: DataFrame, number: int) -> None:
        apply(batch, f"{feed_id(batch.sparkSession, checkpoint)}-{number}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def start_ingest(
    posts: DataFrame,
    root: str,
    checkpoint: str,
    clock: Callable[[], Column],
    available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Upsert every micro-batch into the store at ``root``.

    Delivery is at least once: a batch id that is committed already is skipped,
    and applying one twice would change nothing. Several feeds may share a
    store, one after the other.
    """

    def apply(batch: DataFrame, batch_id: str) -> None:
        store.store_batch(batch.sparkSession, root, batch, clock(), batch_id)

    return _start(posts, checkpoint, apply, available_now, interval)


def start_first_arrivals(
    rows: DataFrame, out: str, checkpoint: str, key: list[str], available_now: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Keep one row per key at ``out``, however late a repeat comes.

    The keys seen are the query's state: a batch looks its own keys up and nothing that is stored is read
    again. There is no watermark, so no key is ever forgotten. Feeds that
    share keys go through one query, as a union. A repeated batch writes its own folder again.
    """
    _keyed_state(rows.sparkSession)

    def apply(batch: DataFrame, batch_id: str) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(rows.dropDuplicates(key), checkpoint, apply, available_now, interval)


def start_daily_requests(
    attempts: DataFrame, out: str, checkpoint: str, available_now: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Running counts of requests per source and UTC day: each micro-batch writes the days it has changed.

    The counts are windows in the query's state. There is no watermark, so late requests count too;
    `read_daily_requests` has the latest count of every day.
    """
    _keyed_state(attempts.sparkSession)

    def apply(batch: DataFrame, batch_id: str) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(requests_per_day(attempts), checkpoint, apply, available_now, interval, mode="update")


def read_daily_requests(spark: SparkSession, out: str) -> DataFrame:
    """Requests per source and UTC day: of each feed the latest count, which is its largest, then all feeds together."""
    schema = "source STRING, day_start TIMESTAMP, requests LONG, batch STRING"
    counts = store.read_or_empty(spark, out, schema, "parquet")
    feed = F.regexp_extract("batch", r"^(.*)-\d+$", 1)
    latest = counts.groupBy(feed.alias("feed"), "source", "day_start").agg(F.max("requests").alias("requests"))
    return latest.groupBy("source", "day_start").agg(F.sum("requests").alias("requests"))
