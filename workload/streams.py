"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.operators import store
from needwell.streaming import ingest as stream
from workload import dialect as q
from workload.ingest import INGEST_SQL, VALID_SQL
from workload.leads import REDUCED_SQL
from workload.registry import query, work_dir
from workload.runs import ATTEMPTS_SQL, attempts
from workload.views import now, raw_posts, ts_text, ts_text_sql


BATCHES = 5


def _landed(df: DataFrame, path: str, *order: str) -> int:
    """A table as files in the given order of arrival; returns how many make a fifth of them.

    Every batch has a file per core, and more where files would have over FILE_ROWS rows, so their number follows the data.
    """
    files = max(BATCHES * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // FILE_ROWS))
    df.repartitionByRange(files, *order).write.parquet(path)
    return -(-files // BATCHES)


FILE_ROWS = 250_000
_LEADS_SQL = f"""{q.with_ctes(*INGEST_SQL, VALID_SQL, REDUCED_SQL)} SELECT post_url, sha256(post_url) AS id, author_name, need_category,
      company, contact_email, website, data_quality_score, 'new' AS status, {ts_text_sql('posted_at')} FROM reduced"""


def _lead_rows(spark: SparkSession, root: str) -> DataFrame:
    return store.read_leads(spark, root).select(
        "post_url", "id", "author_name", "need_category", "company", "contact_email", "website",
        "data_quality_score", "status", ts_text("posted_at"),
    )


@query("streamed_leads", _LEADS_SQL)
def streamed_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead table after the whole input went through the stream in five batches: as one would leave it.

    All rows of a URL land in one file, as the order of files is that of their times on disk.
    """
    work = work_dir(spark, "stream")
    posts = raw_posts(spark, sf_dir)
    part = _landed(posts, f"{work}/in", "source_url")
    arriving = stream.read_posts(spark, f"{work}/in", schema=posts.schema, files_per_batch=part)
    stream.start_ingest(arriving, f"{work}/store", f"{work}/progress", now).awaitTermination()
    return _lead_rows(spark, f"{work}/store")


@query("streamed_leads_of_two_feeds", _LEADS_SQL)
def streamed_leads_of_two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table out of two feeds that number their batches alike; the second updates leads of the first."""
    work = work_dir(spark, "feeds")
    posts = raw_posts(spark, sf_dir)
    for feed in (0, 1):
        late = F.pmod("seq", F.lit(10)) == 9  # these carry the URL of an earlier row
        part = _landed(posts.where(late == bool(feed)), f"{work}/in-{feed}", "source_url")
        arriving = stream.read_posts(spark, f"{work}/in-{feed}", schema=posts.schema, files_per_batch=part)
        stream.start_ingest(arriving, f"{work}/store", f"{work}/progress-{feed}", now).awaitTermination()
    return _lead_rows(spark, f"{work}/store")


@query(
    "streamed_first_arrivals",
    f"""{q.with_ctes(ATTEMPTS_SQL)} SELECT source, count(DISTINCT url) AS urls FROM attempts GROUP BY source""",
)
def streamed_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats dropped on arrival, per source; the files come in no order of time."""
    work = work_dir(spark, "arrivals")
    log = attempts(spark, sf_dir).select("ts", "source", "url", F.hash("seq").alias("place"))
    part = _landed(log, f"{work}/in", "place")
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", part).parquet(f"{work}/in")
    stream.start_first_arrivals(arriving, f"{work}/out", f"{work}/progress", ["source", "url"]).awaitTermination()
    out = spark.read.schema(log.schema).parquet(f"{work}/out")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("urls"))


@query(
    "streamed_requests_per_day",
    f"""{q.with_ctes(ATTEMPTS_SQL)} SELECT source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS requests
      FROM attempts GROUP BY 1, 2""",
)
def streamed_requests_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily requests kept up to date by a stream of files, the latest days first."""
    work = work_dir(spark, "daily")
    log = attempts(spark, sf_dir).select("source", "ts", (-F.unix_seconds("ts")).alias("place"))
    part = _landed(log, f"{work}/in", "place")
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", part).parquet(f"{work}/in")
    stream.start_daily_requests(arriving, f"{work}/out", f"{work}/progress").awaitTermination()
    daily = stream.read_daily_requests(spark, f"{work}/out")
    return daily.select("source", F.date_format("day_start", "yyyy-MM-dd").alias("day"), "requests")


@query(
    "stored_snapshot_tally",
    f"""{q.with_ctes(*INGEST_SQL)} SELECT count(DISTINCT post_url) FILTER (WHERE reason IS NULL) AS leads,
      count(*) FILTER (WHERE reason IS NOT NULL) AS rejects, true AS repeat_skipped FROM tagged""",
)
def stored_snapshot_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store written by one batch and the same batch again: same leads, same rejects."""
    work = work_dir(spark, "store")
    raw = raw_posts(spark, sf_dir)
    store.store_batch(spark, work, raw, now(), "first")
    repeated = store.store_batch(spark, work, raw, now(), "first")
    counted = store.read_leads(spark, work).select(F.lit(1).alias("lead"), F.lit(0).alias("reject"))
    counted = counted.unionAll(store.read_rejects(spark, work).select(F.lit(0), F.lit(1)))
    return counted.agg(
        F.sum("lead").alias("leads"), F.sum("reject").alias("rejects"), F.lit(not repeated).alias("repeat_skipped")
    )


