"""The lead table as versions in Parquet.

A version is written to its own folder and becomes current by a one-row commit
record, so a reader never sees a half-written table and a failed or repeated
write of the same batch changes nothing. One writer at a time.

A batch writes the leads it has touched and, next to them, which rows of which
earlier versions they replace: what it writes grows with the batch, not with the table. After
``LIVE_VERSIONS`` of them a batch writes the whole table again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from needwell import schemas
from needwell.operators import ingest, merge
from needwell.session import spread

# the table is all versions from ``base`` on; without one, the version alone, in whatever layout it was given
_COMMITS = "version LONG, batch_id STRING, base LONG"
# rows that a version replaces: their key and the version they are in
_REPLACED = f"{merge.KEY} STRING, of LONG"
LIVE_VERSIONS = 32


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType, fmt: str) -> DataFrame:
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/commits", _COMMITS, "json")


def current_version(spark: SparkSession, root: str) -> int:
    """Latest committed version, 0 before the first one."""
    return commits(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _state(spark: SparkSession, root: str, batch_id: str | None = None) -> tuple[int, int | None, bool]:
    """Latest version, the first one that counts with it, and whether a batch is committed."""
    known = F.coalesce(F.max(F.col("batch_id") == batch_id), F.lit(False)).alias("known")
    last = F.max_by(F.struct("version", "base"), "version").alias("last")
    row = commits(spark, root).agg(last, known).first()
    return (row.last.version, row.last.base, row.known) if row.last else (0, None, row.known)


def _versions(spark: SparkSession, root: str, kind: str, schema: StructType, numbers: list[int]) -> DataFrame:
    """Rows of some versions, with the number of theirs."""
    reader = spark.read.schema(StructType([*schema.fields, StructField("version", LongType())]))
    return reader.option("basePath", f"{root}/{kind}").parquet(*[f"{root}/{kind}/version={n}" for n in numbers])


def _live_rows(spark: SparkSession, root: str, base: int, version: int) -> DataFrame:
    """The leads of versions that belong together, without replaced rows."""
    rows = _versions(spark, root, "leads", schemas.INTENT_LEADS, [*range(base, version + 1)])
    if base == version:
        return rows
    replaced = _versions(spark, root, "replaced", StructType.fromDDL(_REPLACED), [*range(base + 1, version + 1)])
    gone = replaced.select(merge.KEY, F.col("of").alias("version"))
    return rows.join(gone, [merge.KEY, "version"], "left_anti")


def _read(spark: SparkSession, root: str, version: int, base: int | None) -> DataFrame:
    if version == 0:
        return spark.createDataFrame([], schemas.INTENT_LEADS)
    if base is None:
        return merge.backfill(spark.read.parquet(f"{root}/leads/version={version}"))
    return merge.backfill(_live_rows(spark, root, base, version))


def read_leads(spark: SparkSession, root: str) -> DataFrame:
    """The current lead table, older layouts filled up to the current schema."""
    version, base, _ = _state(spark, root)
    return _read(spark, root, version, base)


def _commit(spark: SparkSession, root: str, leads: DataFrame, batch_id: str, version: int, base: int | None) -> None:
    leads.write.mode("overwrite").parquet(f"{root}/leads/version={version}")
    record = spark.createDataFrame([(version, batch_id, base)], _COMMITS)
    record.coalesce(1).write.mode("append").json(f"{root}/commits")


def commit_leads(spark: SparkSession, root: str, leads: DataFrame, batch_id: str) -> int:
    """Write the whole table as a new version and make it current."""
    version = current_version(spark, root) + 1
    _commit(spark, root, leads, batch_id, version, None)
    return version


def is_committed(spark: SparkSession, root: str, batch_id: str) -> bool:
    return not commits(spark, root).where(F.col("batch_id") == batch_id).isEmpty()


def _touched_leads(spark: SparkSession, root: str, valid: DataFrame, base: int, version: int) -> DataFrame:
    """Stored leads that a batch has rows of; writes down that the next version replaces them.

    Keys are looked up first, without the texts; then only versions with such keys are read.
    """
    path = f"{root}/replaced/version={version + 1}"
    keys = _live_rows(spark, root, base, version).select(merge.KEY, F.col("version").alias("of"))
    keys.join(valid.select(merge.KEY), merge.KEY, "left_semi").write.mode("overwrite").parquet(path)
    replaced = spark.read.schema(_REPLACED).parquet(path)
    numbers = sorted(r.of for r in replaced.select("of").distinct().collect())  # at most LIVE_VERSIONS
    if not numbers:
        return spark.createDataFrame([], schemas.INTENT_LEADS)
    rows = _versions(spark, root, "leads", schemas.INTENT_LEADS, numbers)
    touched = replaced.select(merge.KEY, F.col("of").alias("version"))
    return rows.join(touched, [merge.KEY, "version"], "left_semi").drop("version")


def store_batch(spark: SparkSession, root: str, raw: DataFrame, now: Column, batch_id: str) -> bool:
    """Ingest one batch: upsert its valid rows, keep its rejects. Safe to repeat.

    The tagged rows are staged once as files that both outputs read, so the
    cleaning pass runs once and a lost executor costs no recomputation of it.
    Cleaning is bound by CPU and batches come as few files: rows are dealt out by
    number and URL, so neither a file nor a frequent URL is one task.
    """
    version, base, known = _state(spark, root, batch_id)
    if known:
        return False
    staged_path = f"{root}/staged/batch={batch_id}"
    slim = ingest.settled(ingest.tag_posts(spread(raw, "seq", "source_url", rounds=3)))
    slim.write.mode("overwrite").parquet(staged_path)
    staged = spark.read.schema(slim.schema).parquet(staged_path)
    ingest.reject_rows(staged, now).write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
    valid = ingest.valid_rows(staged)
    if base is None or version - base + 1 >= LIVE_VERSIONS:
        stored, base = _read(spark, root, version, base), version + 1
    else:
        stored = _touched_leads(spark, root, valid, base, version)
    _commit(spark, root, merge.upsert(stored, valid, now), batch_id, version + 1, base)
    return True


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """The rejected rows of all committed batches."""
    fields = [*schemas.REJECTS.fields, StructField("batch", StringType())]
    rows = read_or_empty(spark, f"{root}/rejects", StructType(fields), "parquet")
    done = commits(spark, root).select(F.col("batch_id").alias("batch")).distinct()
    return rows.join(done, "batch", "left_semi").drop("batch")


def save_bucketed(leads: DataFrame, table: str, path: str, buckets: int) -> None:
    """Leads as a table bucketed by key: a later upsert shuffles only its batch."""
    writer = leads.write.mode("overwrite").option("path", path).format("parquet")
    writer.bucketBy(buckets, merge.KEY).sortBy(merge.KEY).saveAsTable(table)
