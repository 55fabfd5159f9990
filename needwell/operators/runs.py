"""Run accounting over an attempt log.

``attempts`` holds one row per page request: ``run_id, source, query, seq, url,
outcome, ts`` and optionally ``rejected`` (an extracted page the ingest refused)
and ``stored`` (``new`` or ``updated``: what the upsert made of it).
``seq`` is a unique, increasing number; order inside a run is always by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from needwell.config import RunLimits
from needwell.functions.html import BLOCKED, OK, PARSE_ERROR

TRANSIENT = "transient"
CHUNK_ROWS = 100_000


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


def requests_since(runs: DataFrame, sources: DataFrame, since: Column) -> DataFrame:
    """Requests each listed source has spent since a time, zero when none."""
    spent = (
        runs.where(F.col("started_at") >= since)
        .groupBy("source")
        .agg(F.sum("pages_visited").alias("used"))
    )
    return sources.join(spent, "source", "left").select("source", F.coalesce("used", F.lit(0)).alias("used"))


def within_budget(attempts: DataFrame, used: DataFrame, cap: int) -> DataFrame:
    """Attempts admitted by the daily cap per source, given the requests spent before.

    ``used`` holds (source, day, used). Only the first ``cap`` rows of a group can
    pass, so Spark keeps at most ``cap`` per task before the shuffle.
    """
    day = F.to_date("ts")
    order = W.partitionBy("source", "day").orderBy("seq")
    first = (
        attempts.withColumn("day", day)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= cap)
    )
    spent = F.coalesce("used", F.lit(0))
    return (
        first.join(used, ["source", "day"], "left")
        .where(F.col("position") + spent <= cap)
        .drop("used", "position")
    )


def limit_cutoff(attempts: DataFrame, limit: int, key: str = "run_id") -> DataFrame:
    """``seq`` of the attempt that fills a run's extraction limit, for runs that reach it."""
    order = W.partitionBy(key).orderBy("seq")
    extracted = attempts.where(_is(OK)).withColumn("_n", F.row_number().over(order))
    return (
        extracted.where(F.col("_n") <= limit)
        .groupBy(key)
        .agg(F.max("seq").alias("limit_seq"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == limit)
        .select(key, "limit_seq")
    )


def cap_cutoff(attempts: DataFrame, cap: int, key: str = "run_id") -> DataFrame:
    """``seq`` of the first attempt a run may no longer make, for runs that get there.

    The budget is one per source and day, whichever runs spend it. Looks at
    ``cap + 1`` attempts per source and day at most; earlier spending of the same
    day is taken from an optional ``used_before`` column.
    """
    dated = attempts.withColumn("_day", F.to_date("ts"))
    order = W.partitionBy("source", "_day").orderBy("seq")
    used = F.col("used_before") if "used_before" in attempts.columns else F.lit(0)
    numbered = dated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap + 1)
    over = numbered.where(F.col("_n") > F.greatest(F.lit(0), F.lit(cap) - used))
    spent = over.groupBy("source", "_day").agg(F.min("seq").alias("_from"))
    late = dated.join(spent, ["source", "_day"]).where(F.col("seq") >= F.col("_from"))
    return late.groupBy(key).agg(F.min("seq").alias("cap_seq"))


def abort_cutoff(
    attempts: DataFrame, block_limit: int, key: str = "run_id", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``seq`` of the block that ends a run, for runs that hit the limit.

    Blocks count until the next success; other failures neither count nor reset.
    A run may hold a third of all attempts, so it is cut into ``seq`` ranges: a
    window inside each range, then one over the range summaries, which carry the
    blocks still open at its end.
    """
    blocked, success = _is(BLOCKED).cast("int"), _is(OK).cast("int")
    chunk = F.floor(F.col("seq") / chunk_rows)
    in_chunk = W.partitionBy(key, "_chunk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    in_island = (
        W.partitionBy(key, "_chunk", "_island").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    )
    # transient and parse failures play no part here
    marked = (
        attempts.where(_is(BLOCKED) | _is(OK))
        .select(key, "seq", chunk.alias("_chunk"), blocked.alias("_b"), success.alias("_s"))
        .withColumn("_island", F.sum("_s").over(in_chunk))
        .withColumn("_open", F.sum("_b").over(in_island))
    )
    leading = (F.col("_island") == 0) & (F.col("_b") == 1) & (F.col("_open") <= block_limit)
    summary = marked.groupBy(key, "_chunk").agg(
        F.max("_s").alias("_has_success"),
        F.max_by("_open", "seq").alias("_tail"),
        F.min(F.when((F.col("_b") == 1) & (F.col("_open") >= block_limit), F.col("seq"))).alias("_inside"),
        # at most block_limit entries by construction
        F.array_sort(F.collect_list(F.when(leading, F.col("seq")))).alias("_leading"),
    )
    by_chunk = W.partitionBy(key).orderBy("_chunk")
    running = by_chunk.rowsBetween(W.unboundedPreceding, 0)
    in_stretch = W.partitionBy(key, "_stretch").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    carried = (
        summary.withColumn("_stretch", F.sum("_has_success").over(running))
        .withColumn("_after", F.sum("_tail").over(in_stretch))
        .withColumn("_before", F.coalesce(F.lag("_after").over(by_chunk), F.lit(0)))
    )
    missing = F.greatest(F.lit(1), F.lit(block_limit) - F.col("_before")).cast("int")
    first = F.least(F.try_element_at("_leading", missing), F.col("_inside"))
    return carried.groupBy(key).agg(F.min(first).alias("abort_seq")).where(F.col("abort_seq").isNotNull())


def stop_runs(attempts: DataFrame, limits: RunLimits, key: str = "run_id") -> DataFrame:
    """Attempts that really happen under the limits, with ``abort_seq`` and ``cap_seq``.

    Each rule cuts a run at a position that depends only on earlier attempts, so
    the earliest cut decides. The cut tables hold one row per run at most.
    """
    joined = attempts.join(abort_cutoff(attempts, limits.block_limit, key), key, "left")
    joined = joined.join(cap_cutoff(attempts, limits.daily_cap, key), key, "left")
    if limits.extracted_limit is not None:
        joined = joined.join(limit_cutoff(attempts, limits.extracted_limit, key), key, "left")
    else:
        joined = joined.withColumn("limit_seq", F.lit(None).cast("bigint"))
    seq = F.col("seq")
    beyond = (seq > F.col("abort_seq")) | (seq > F.col("limit_seq")) | (seq >= F.col("cap_seq"))
    return joined.where(~F.coalesce(beyond, F.lit(False)))


def summarize_runs(stopped: DataFrame, limits: RunLimits) -> DataFrame:
    """One audit row per run: status, counters, times and message."""
    rejected = F.col("rejected") if "rejected" in stopped.columns else F.lit(False)
    stored = F.col("stored") if "stored" in stopped.columns else F.lit(None).cast("string")
    parse_failures = F.count_if(_is(PARSE_ERROR))
    refused = F.count_if(_is(OK) & rejected)
    aborted = F.max("seq") == F.max("abort_seq")
    full = F.max("limit_seq")
    capped = F.max("cap_seq").isNotNull() & (full.isNull() | (full >= F.max("cap_seq")))
    grouped = stopped.groupBy("run_id", "source", "query").agg(
        F.count(F.lit(1)).alias("pages_visited"),
        F.count_if(_is(OK)).alias("leads_found"),
        (parse_failures + refused).alias("rejects"),
        F.count_if(_is(TRANSIENT)).alias("errors"),
        F.count_if(stored == "new").alias("stored_new"),
        F.count_if(stored == "updated").alias("stored_updated"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
        F.coalesce(aborted, F.lit(False)).alias("_aborted"),
        capped.alias("_capped"),
    )
    return grouped.select(
        "run_id",
        "source",
        "query",
        F.when(F.col("_aborted"), "aborted").otherwise("completed").alias("status"),
        "pages_visited",
        "leads_found",
        "rejects",
        "errors",
        "stored_new",
        "stored_updated",
        "started_at",
        "finished_at",
        ((F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)).alias("duration_seconds"),
        F.when(F.col("_aborted"), F.lit(f"aborted after {limits.block_limit} consecutive blocks"))
        .when(F.col("_capped"), F.lit(f"daily request cap reached ({limits.daily_cap})"))
        .alias("error_message"),
    )


def audit_runs(attempts: DataFrame) -> DataFrame:
    """One audit row per run out of the log as it was written, in one aggregation.

    ``status`` and ``message``, where the log has them, are those of the run's last attempt.
    """
    has = set(attempts.columns)
    optional = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    last = F.max_by(F.struct(optional("status", "string").alias("status"), optional("message", "string").alias("message")), "seq")
    refused = F.coalesce(optional("rejected", "boolean"), F.lit(False))
    grouped = attempts.groupBy("run_id", "source", "query").agg(
        last.alias("_last"),
        F.count(F.lit(1)).alias("pages_visited"),
        F.count_if(_is(OK)).alias("leads_found"),
        F.count_if(_is(PARSE_ERROR) | (_is(OK) & refused)).alias("rejects"),
        F.count_if(_is(TRANSIENT)).alias("errors"),
        F.count_if(optional("stored", "string") == "new").alias("stored_new"),
        F.count_if(optional("stored", "string") == "updated").alias("stored_updated"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
    )
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return grouped.select(
        "run_id", "source", "query", F.coalesce("_last.status", F.lit("completed")).alias("status"),
        "pages_visited", "leads_found", "rejects", "errors", "stored_new", "stored_updated", "started_at", "finished_at",
        seconds.alias("duration_seconds"), F.col("_last.message").alias("error_message"),
    )


def batch_totals(summaries: DataFrame, key: str = "query") -> DataFrame:
    """Counters per need and, where the need is NULL, for the whole batch."""
    counters = ("leads_found", "stored_new", "stored_updated", "rejects", "errors")
    return summaries.rollup(key).agg(*[F.sum(c).alias(c) for c in counters], F.count(F.lit(1)).alias("runs"))


def seen_urls(attempts: DataFrame) -> DataFrame:
    """URLs that were extracted, one row per (source, query, url)."""
    return attempts.where(_is(OK)).select("source", "query", "url").distinct()


def merge_seen(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Progress after a run: the union of both sets."""
    columns = ["source", "query", "url"]
    return stored.select(*columns).unionByName(new.select(*columns)).distinct()


def replace_progress(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Progress where each (source, query) of ``new`` takes over as a whole."""
    groups = new.select("source", "query").distinct()
    kept = stored.join(groups, ["source", "query"], "left_anti")
    return kept.unionByName(new.select(*kept.columns)).distinct()


def needs_in_order(needs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Run totals in the order of the needs list; needs without a run stay."""
    totals = summaries.groupBy("query").agg(
        *[F.sum(c).alias(c) for c in ("pages_visited", "leads_found", "rejects", "errors")]
    )
    joined = needs.join(totals, needs["need"] == totals["query"], "left")
    return joined.select(
        "pos",
        "need",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pages_visited", "leads_found", "rejects", "errors")],
    )


def requests_per_day(attempts: DataFrame) -> DataFrame:
    """Requests per source and UTC day as a tumbling window."""
    return (
        attempts.groupBy("source", F.window("ts", "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("source", F.col("_w.start").alias("day_start"), "requests")
    )
