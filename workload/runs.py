"""Run accounting over an attempt log derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.config import NEEDS, RunLimits
from needwell.functions.dates import clock
from needwell.operators import runs
from needwell.sources.needs import needs_table
from workload import dialect as q
from workload.registry import query, table
from workload.views import choose

LIMITS = RunLimits(daily_cap=60, block_limit=4, extracted_limit=22)


def attempts(spark: SparkSession, sf_dir: str, more: dict[str, str] | None = None) -> DataFrame:
    """One attempt per event; a run is one source on one day. More columns may be given as expressions."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    outcome = (
        F.when(kind == "error", "blocked")
        .when(kind == "signup", "transient")
        .when(kind == "click", "parse_error")
        .otherwise("ok")
    )
    source = F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string"))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(source, F.lit("-"), F.date_format(ts, "yyyyMMdd")).alias("run_id"),
        source.alias("source"),
        choose(NEEDS[:7], "dayofmonth(ts)").alias("query"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("https://social.example/posts/p_"), (F.col("event_id") % 4001).cast("string")).alias("url"),
        outcome.alias("outcome"),
        ts.alias("ts"),
        (F.col("value") > 20).alias("rejected"),
        F.when((outcome == "ok") & (F.col("value") <= 20), F.when(F.col("event_id") < 4001, "new").otherwise("updated")).alias("stored"),
        *[F.expr(e).alias(name) for name, e in (more or {}).items()],
    )


ATTEMPTS_SQL = (
    "attempts",
    f"""
  SELECT 'src' || (user_id % 5) || '-' || strftime(ts, '%Y%m%d') AS run_id, 'src' || (user_id % 5) AS source,
    {q.pick(NEEDS[:7], 'day(ts)')} AS query, event_id AS seq,
    'https://social.example/posts/p_' || (event_id % 4001) AS url,
    CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'transient' WHEN 'click' THEN 'parse_error'
      ELSE 'ok' END AS outcome, ts, value > 20 AS rejected,
    CASE WHEN event_type NOT IN ('error', 'signup', 'click') AND value <= 20
      THEN CASE WHEN event_id < 4001 THEN 'new' ELSE 'updated' END END AS stored
  FROM events""",
)

_ISLAND_SQL = (
    "marked",
    """SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY run_id ORDER BY seq) AS island,
      row_number() OVER (PARTITION BY run_id ORDER BY seq) AS pos,
      sum((outcome = 'ok')::INT) OVER (PARTITION BY run_id ORDER BY seq) AS n_ok FROM attempts""",
)
_BLOCKS_SQL = (
    "blocks",
    "SELECT *, sum((outcome = 'blocked')::INT) OVER (PARTITION BY run_id, island ORDER BY seq) AS open FROM marked",
)
_CUTS_SQL = (
    "cuts",
    f"""SELECT run_id, min(seq) FILTER (WHERE outcome = 'blocked' AND open >= {LIMITS.block_limit}) AS abort_seq,
      min(seq) FILTER (WHERE outcome = 'ok' AND n_ok = {LIMITS.extracted_limit}) AS limit_seq,
      min(seq) FILTER (WHERE pos = {LIMITS.daily_cap + 1}) AS cap_seq FROM blocks GROUP BY run_id""",
)
_STOPPED_SQL = (
    "stopped",
    """SELECT a.*, abort_seq, limit_seq, cap_seq FROM attempts a JOIN cuts USING (run_id)
      WHERE seq <= coalesce(abort_seq, seq) AND seq <= coalesce(limit_seq, seq) AND seq < coalesce(cap_seq, seq + 1)""",
)
_SUMMARY_SQL = (
    "summary",
    f"""SELECT run_id, source, query, CASE WHEN max(seq) = max(abort_seq) THEN 'aborted' ELSE 'completed' END AS status,
      count(*) AS pages_visited, count_if(outcome = 'ok') AS leads_found,
      count_if(outcome = 'parse_error') + count_if(outcome = 'ok' AND rejected) AS rejects,
      count_if(outcome = 'transient') AS errors, count(*) FILTER (WHERE stored = 'new') AS stored_new,
      count(*) FILTER (WHERE stored = 'updated') AS stored_updated, min(ts) AS started_at, max(ts) AS finished_at,
      CASE WHEN max(seq) = max(abort_seq) THEN 'aborted after {LIMITS.block_limit} consecutive blocks'
        WHEN max(cap_seq) IS NOT NULL AND (max(limit_seq) IS NULL OR max(limit_seq) >= max(cap_seq))
        THEN 'daily request cap reached ({LIMITS.daily_cap})' END AS error_message
      FROM stopped GROUP BY run_id, source, query""",
)
RUN_SQL = (ATTEMPTS_SQL, _ISLAND_SQL, _BLOCKS_SQL, _CUTS_SQL, _STOPPED_SQL, _SUMMARY_SQL)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    stopped = runs.stop_runs(attempts(spark, sf_dir), LIMITS)
    return runs.summarize_runs(stopped, LIMITS)


@query("block_aborts", f"{q.with_ctes(*RUN_SQL)} SELECT run_id, abort_seq FROM cuts WHERE abort_seq IS NOT NULL")
def block_aborts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where consecutive blocks end a run; small ranges so that carries happen."""
    return runs.abort_cutoff(attempts(spark, sf_dir), LIMITS.block_limit, chunk_rows=40)


@query("extraction_limits", f"{q.with_ctes(*RUN_SQL)} SELECT run_id, limit_seq FROM cuts WHERE limit_seq IS NOT NULL")
def extraction_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that fills a run's extraction limit."""
    return runs.limit_cutoff(attempts(spark, sf_dir), LIMITS.extracted_limit)


@query(
    "daily_budget",
    f"""{q.with_ctes(ATTEMPTS_SQL, ('numbered', '''SELECT *, row_number() OVER (PARTITION BY source, ts::DATE ORDER BY seq) AS pos
      FROM attempts'''))} SELECT source, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS admitted, max(seq) AS last_seq
    FROM numbered WHERE pos + (day(ts) % 4) * 10 <= 60 GROUP BY 1, 2""",
)
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts admitted by the daily cap after earlier spending."""
    log = attempts(spark, sf_dir)
    used = log.select("source", F.to_date("ts").alias("day")).distinct()
    used = used.withColumn("used", (F.dayofmonth("day") % 4) * 10)
    admitted = runs.within_budget(log, used, LIMITS.daily_cap)
    return admitted.groupBy("source", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("admitted"), F.max("seq").alias("last_seq")
    )


_SUMMARY_COLUMNS = "run_id, source, query, status, pages_visited, leads_found, rejects, errors, stored_new, stored_updated, error_message"


@query(
    "run_summaries",
    f"""{q.with_ctes(*RUN_SQL)} SELECT {_SUMMARY_COLUMNS}, epoch_us(started_at) AS started, epoch_us(finished_at) AS finished
      FROM summary""",
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of all runs under limit, cap and block rules."""
    return summaries(spark, sf_dir).select(
        *[c.strip() for c in _SUMMARY_COLUMNS.split(",")],
        F.unix_micros("started_at").alias("started"),
        F.unix_micros("finished_at").alias("finished"),
    )


@query(
    "batch_totals",
    f"""{q.with_ctes(*RUN_SQL)} SELECT query, sum(leads_found)::BIGINT AS leads_found, sum(rejects)::BIGINT AS rejects,
      sum(errors)::BIGINT AS errors, sum(stored_new)::BIGINT AS stored_new, sum(stored_updated)::BIGINT AS stored_updated,
      count(*) AS runs FROM summary GROUP BY ROLLUP (query)""",
)
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per need and for the whole batch."""
    return runs.batch_totals(summaries(spark, sf_dir))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q.lit(v) for v in r) + ")" for r in rows)


@query(
    "needs_in_order",
    f"""{q.with_ctes(*RUN_SQL)} SELECT n.pos, n.need, coalesce(sum(pages_visited), 0)::BIGINT AS pages_visited,
      coalesce(sum(leads_found), 0)::BIGINT AS leads_found, coalesce(sum(rejects), 0)::BIGINT AS rejects,
      coalesce(sum(errors), 0)::BIGINT AS errors
    FROM (VALUES {_values(enumerate(NEEDS))}) AS n(pos, need) LEFT JOIN summary s ON s.query = n.need GROUP BY 1, 2""",
)
def needs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per need in list order, needs without runs included."""
    return runs.needs_in_order(needs_table(spark, NEEDS), summaries(spark, sf_dir))


@query(
    "requests_used",
    f"""{q.with_ctes(*RUN_SQL)} SELECT s.source, coalesce(sum(pages_visited), 0)::BIGINT AS used FROM
      (VALUES ('src0'), ('src1'), ('src2'), ('src3'), ('src4'), ('src9')) AS s(source)
      LEFT JOIN summary r ON r.source = s.source AND r.started_at >= TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def requests_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per source since a time, zero for idle sources."""
    listed = spark.createDataFrame([(s,) for s in ("src0", "src1", "src2", "src3", "src4", "src9")], "source STRING")
    return runs.requests_since(summaries(spark, sf_dir), listed, clock("2024-01-20T00:00:00Z"))


# the log as a collector writes it: each attempt with the state of its run at that time
_STATED = "CASE event_type WHEN 'error' THEN 'aborted' WHEN 'signup' THEN 'running' ELSE 'completed' END"
_NOTE = "CASE WHEN event_type = 'error' THEN concat('stopped at ', event_id) END"
_AUDIT_SQL = (
    ("written", ATTEMPTS_SQL[1].replace("SELECT", f"SELECT {_STATED} AS status, {_NOTE} AS message,", 1)),
    (
        "audit",
        """SELECT run_id, source, query, first(status ORDER BY seq DESC) AS status, first(message ORDER BY seq DESC) AS error_message,
          count(*) AS pages_visited, count_if(outcome = 'ok') AS leads_found,
          count_if(outcome = 'parse_error') + count_if(outcome = 'ok' AND rejected) AS rejects, count_if(outcome = 'transient') AS errors,
          count(*) FILTER (WHERE stored = 'new') AS stored_new, count(*) FILTER (WHERE stored = 'updated') AS stored_updated,
          min(ts) AS started_at, max(ts) AS finished_at FROM written GROUP BY run_id, source, query""",
    ),
)


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.audit_runs(attempts(spark, sf_dir, {"status": _STATED, "message": _NOTE}))


@query(
    "run_audit",
    f"""{q.with_ctes(*_AUDIT_SQL)} SELECT {_SUMMARY_COLUMNS}, epoch_us(started_at) AS started, epoch_us(finished_at) AS finished FROM audit""",
)
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of the log as it was written."""
    return audits(spark, sf_dir).select(
        *[c.strip() for c in _SUMMARY_COLUMNS.split(",")],
        F.unix_micros("started_at").alias("started"),
        F.unix_micros("finished_at").alias("finished"),
    )


@query(
    "audit_totals",
    f"""{q.with_ctes(*_AUDIT_SQL)} SELECT query, sum(leads_found)::BIGINT AS leads_found, sum(rejects)::BIGINT AS rejects,
      sum(errors)::BIGINT AS errors, sum(stored_new)::BIGINT AS stored_new, sum(stored_updated)::BIGINT AS stored_updated,
      count(*) AS runs FROM audit GROUP BY ROLLUP (query)""",
)
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per need and for the whole batch, of the written log."""
    return runs.batch_totals(audits(spark, sf_dir))


@query(
    "audit_by_need",
    f"""{q.with_ctes(*_AUDIT_SQL)} SELECT n.pos, n.need, coalesce(sum(pages_visited), 0)::BIGINT AS pages_visited,
      coalesce(sum(leads_found), 0)::BIGINT AS leads_found, coalesce(sum(rejects), 0)::BIGINT AS rejects,
      coalesce(sum(errors), 0)::BIGINT AS errors
    FROM (VALUES {_values(enumerate(NEEDS))}) AS n(pos, need) LEFT JOIN audit s ON s.query = n.need GROUP BY 1, 2""",
)
def audit_by_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the written log in the order of the needs."""
    return runs.needs_in_order(needs_table(spark, NEEDS), audits(spark, sf_dir))


@query(
    "audited_requests",
    f"""{q.with_ctes(*_AUDIT_SQL)} SELECT s.source, coalesce(sum(pages_visited), 0)::BIGINT AS used FROM
      (VALUES ('src0'), ('src1'), ('src2'), ('src3'), ('src4'), ('src9')) AS s(source)
      LEFT JOIN audit r ON r.source = s.source AND r.started_at >= TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def audited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per source since a time, of the written log."""
    listed = spark.createDataFrame([(s,) for s in ("src0", "src1", "src2", "src3", "src4", "src9")], "source STRING")
    return runs.requests_since(audits(spark, sf_dir), listed, clock("2024-01-20T00:00:00Z"))


@query("seen_urls", f"{q.with_ctes(ATTEMPTS_SQL)} SELECT DISTINCT source, query, url FROM attempts WHERE outcome = 'ok'")
def seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted URLs per run key as rows."""
    return runs.seen_urls(attempts(spark, sf_dir))


_EARLY = "ts < TIMESTAMP '2024-01-15'"


@query(
    "unseen_candidates",
    f"""{q.with_ctes(ATTEMPTS_SQL)} SELECT DISTINCT source, query, url FROM attempts a WHERE NOT EXISTS (
      SELECT 1 FROM attempts s WHERE s.outcome = 'ok' AND s.{_EARLY} AND s.source = a.source AND s.query = a.query AND s.url = a.url)""",
)
def unseen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of resumed runs without the URLs extracted earlier."""
    from needwell.operators.discover import not_seen

    log = attempts(spark, sf_dir)
    seen = runs.seen_urls(log.where(F.expr(_EARLY)))
    return not_seen(log.select("source", "query", "url").distinct(), seen)


@query(
    "progress_merged",
    f"""{q.with_ctes(ATTEMPTS_SQL)} SELECT source, query, count(DISTINCT url) AS urls FROM attempts WHERE outcome = 'ok' GROUP BY 1, 2""",
)
def progress_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of two halves of the log united."""
    log = attempts(spark, sf_dir)
    early, late = log.where(F.expr(_EARLY)), log.where(~F.expr(_EARLY))
    merged = runs.merge_seen(runs.seen_urls(early), runs.seen_urls(late))
    return merged.groupBy("source", "query").agg(F.count(F.lit(1)).alias("urls"))


@query(
    "progress_replaced",
    f"""{q.with_ctes(ATTEMPTS_SQL, ('ok', "SELECT DISTINCT source, query, url, " + _EARLY + " AS early FROM attempts WHERE outcome = 'ok'"))}
    SELECT source, query, count(DISTINCT url) AS urls FROM ok o
    WHERE NOT early OR NOT EXISTS (SELECT 1 FROM ok n WHERE NOT n.early AND n.source = o.source AND n.query = o.query)
    GROUP BY 1, 2""",
)
def progress_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress where a later run's set replaces the earlier one as a whole."""
    log = attempts(spark, sf_dir)
    early, late = log.where(F.expr(_EARLY)), log.where(~F.expr(_EARLY))
    replaced = runs.replace_progress(runs.seen_urls(early), runs.seen_urls(late))
    return replaced.groupBy("source", "query").agg(F.count(F.lit(1)).alias("urls"))


@query(
    "requests_per_day",
    f"""{q.with_ctes(ATTEMPTS_SQL)} SELECT source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS requests
      FROM attempts GROUP BY 1, 2""",
)
def requests_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per source and UTC day."""
    daily = runs.requests_per_day(attempts(spark, sf_dir))
    return daily.select("source", F.date_format("day_start", "yyyy-MM-dd").alias("day"), "requests")
