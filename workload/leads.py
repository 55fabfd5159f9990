"""Upsert, rescoring, ranking, counts and joins over stored leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell import schemas
from needwell.functions import dates
from needwell.config import NEEDS
from needwell.operators import buckets, discover, merge, rank, runs, score
from needwell.session import staged
from needwell.plans.export import export_explained, export_leads, export_view
from needwell.sources.posts import read_raw_posts
from workload import dialect as q
from workload.ingest import (
    CFG,
    INGEST_SQL,
    SEEN_SQL,
    VALID_SQL,
    category_list_sql,
    clean_posts,
    score_ctes,
)
from workload.registry import query, table, work_dir
from workload.text import EMAIL_SQL, headline_company_sql, post_company_sql, website_sql
from workload.runs import ATTEMPTS_SQL, attempts
from workload.views import NOW_SQL, POSTS_SQL, now, raw_posts, ts_text, ts_text_sql

# A stored table from an earlier day: every key divisible by three was seen
# before, with older values, a score and some facts of its own.
STORED_AT = "2024-01-20T00:00:00Z"


def stored_leads(arrivals: DataFrame) -> DataFrame:
    """Leads of an earlier day, derived from the first arrival of a third of the keys."""
    key_number = F.regexp_extract("post_url", r"_(\d+)$", 1).cast("bigint")
    firsts = arrivals.where((F.col("seq") == key_number) & (key_number % 3 == 0))
    values = {
        "id": merge.lead_id(F.col("post_url")),
        "author_name": F.col("author_name"),
        "author_profile_url": F.lit("https://social.example/in/old"),
        "author_headline": F.lit("Old headline"),
        "company": F.when(F.col("seq") % 2 == 0, "Old Company"),
        "contact_email": F.lit("old@example.org"),
        "website": F.lit(None).cast("string"),
        "need_text": F.col("need_text"),
        "need_category": F.lit("old need"),
        "post_url": F.col("post_url"),
        "post_text": F.col("post_text"),
        "posted_at": dates.clock("2024-01-19T00:00:00Z"),
        "platform": F.col("platform"),
        "freshness_score": F.lit(40),
        "lead_score": F.lit(33),
        "category": F.lit("client_lead"),
        "suggested_angle": F.lit(None).cast("string"),
        "data_quality_score": F.lit(50),
        "quality_flags": F.array(F.lit("missing_company")),
        "status": F.lit("scored"),
        "lead_id": F.lit(None).cast("string"),
        "first_seen": dates.clock(STORED_AT),
        "last_updated": dates.clock(STORED_AT),
    }
    return firsts.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.INTENT_LEADS])


_KEY_NUMBER = r"regexp_extract(post_url, '_(\d+)$', 1)::BIGINT"
STORED_SQL = (
    "stored",
    f"""
  SELECT sha256(post_url) AS id, author_name, 'https://social.example/in/old' AS author_profile_url,
    'Old headline' AS author_headline, CASE WHEN seq % 2 = 0 THEN 'Old Company' END AS company,
    'old@example.org' AS contact_email, NULL::VARCHAR AS website, need_text, 'old need' AS need_category, post_url,
    post_text, TIMESTAMP '2024-01-19' AS posted_at, platform, 40 AS freshness_score, 33 AS lead_score,
    'client_lead' AS category, 50 AS data_quality_score, ['missing_company'] AS quality_flags, 'scored' AS status,
    TIMESTAMP '2024-01-20' AS first_seen, TIMESTAMP '2024-01-20' AS last_updated
  FROM valid WHERE seq = {_KEY_NUMBER} AND {_KEY_NUMBER} % 3 = 0""",
)
_ALWAYS = ("author_name", "need_text", "need_category", "post_text", "platform", "data_quality_score", "quality_flags")
_MAYBE = ("author_profile_url", "author_headline", "company", "contact_email", "website", "posted_at")
REDUCED_SQL = (
    "reduced",
    "SELECT post_url, "
    + ", ".join(f"max_by({c}, seq) AS {c}" for c in _ALWAYS)
    + ", "
    + ", ".join(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _MAYBE)
    + ", min_by(need_category, seq) AS first_need, count(*) AS arrivals FROM valid GROUP BY post_url",
)
_VALUES = _ALWAYS + _MAYBE
MERGED_SQL = (
    "merged",
    f"""
  SELECT coalesce(o.post_url, n.post_url) AS post_url, coalesce(o.id, sha256(n.post_url)) AS id,
    {', '.join(f'coalesce(n.{c}, o.{c}) AS {c}' for c in _VALUES)},
    coalesce(o.freshness_score, 0) AS freshness_score, o.lead_score, coalesce(o.category, 'unclear') AS category,
    coalesce(o.status, 'new') AS status, coalesce(o.first_seen, {NOW_SQL}) AS first_seen,
    CASE WHEN o.id IS NULL OR {' OR '.join(f'coalesce(n.{c}, o.{c}) IS DISTINCT FROM o.{c}' for c in _VALUES)}
      THEN {NOW_SQL} ELSE o.last_updated END AS last_updated,
    o.id IS NULL AS was_new, coalesce(n.arrivals, 0) AS arrivals, n.first_need
  FROM stored o FULL OUTER JOIN reduced n ON o.post_url = n.post_url""",
)
UPSERT_SQL = (*INGEST_SQL, VALID_SQL, STORED_SQL, REDUCED_SQL, MERGED_SQL)


def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid arrivals, written down: the stored side is derived from them too, and the posts are cleaned once."""
    return staged(clean_posts(spark, sf_dir), "arrivals")


def merged_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_with_stored(arrived(spark, sf_dir))


def merged_with_stored(arrivals: DataFrame) -> DataFrame:
    return merge.merge_arrivals(stored_leads(arrivals), merge.reduce_arrivals(arrivals), now())


_LEAD_LIST = (
    "post_url, id, author_name, author_profile_url, author_headline, company, contact_email, website, need_text, "
    "need_category, post_text, platform, freshness_score, lead_score, category, data_quality_score, status"
)


def printable(leads: DataFrame) -> DataFrame:
    names = [c.strip() for c in _LEAD_LIST.split(",")]
    return leads.select(
        *names,
        F.array_join("quality_flags", ",").alias("quality_flags"),
        *[ts_text(c) for c in ("posted_at", "first_seen", "last_updated")],
    )


def printable_sql(relation: str) -> str:
    times = ", ".join(ts_text_sql(c) for c in ("posted_at", "first_seen", "last_updated"))
    return f"SELECT {_LEAD_LIST}, array_to_string(quality_flags, ',') AS quality_flags, {times} FROM {relation}"


@query("batch_reduction", f"""{q.with_ctes(*INGEST_SQL, VALID_SQL, REDUCED_SQL)}
    SELECT post_url, author_name, need_category, company, contact_email, website, author_headline, first_need, arrivals,
      {ts_text_sql('posted_at')} FROM reduced""")
def batch_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last non-NULL value per key inside one batch."""
    reduced = merge.reduce_arrivals(clean_posts(spark, sf_dir))
    return reduced.select(
        "post_url", "author_name", "need_category", "company", "contact_email", "website", "author_headline",
        "first_need", "arrivals", ts_text("posted_at"),
    )


@query("lead_upsert", f"{q.with_ctes(*UPSERT_SQL)} {printable_sql('merged')}")
def lead_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after a batch: inserts, null-preserving updates, provenance."""
    return printable(merged_leads(spark, sf_dir))


# --- leads in buckets ----------------------------------------------------------

BUCKETS = 32
_BATCH = "seq % 100 = 7"
# a batch of one arrival in a hundred on top of the stored leads and the rest of the arrivals
_BATCH_SQL = (
    ("first_batch", "SELECT * FROM valid WHERE NOT coalesce(" + _BATCH + ", false)"),
    (REDUCED_SQL[0] + "_first", REDUCED_SQL[1].replace("FROM valid", "FROM first_batch")),
    ("kept", MERGED_SQL[1].replace("JOIN reduced", "JOIN reduced_first")),
    ("second_batch", "SELECT * FROM valid WHERE " + _BATCH),
    (REDUCED_SQL[0] + "_second", REDUCED_SQL[1].replace("FROM valid", "FROM second_batch")),
    ("after", MERGED_SQL[1].replace("JOIN reduced", "JOIN reduced_second").replace("FROM stored", "FROM kept").replace(NOW_SQL, "TIMESTAMP '2024-02-01 00:00:00'")),
)


def bucketed(spark: SparkSession, sf_dir: str, arrivals: DataFrame, first: DataFrame) -> str:
    """The folder of a bucketed table: the stored leads, then a first batch."""
    path = f"{work_dir(spark, 'buckets')}/leads"
    buckets.write_buckets(stored_leads(arrivals), path, BUCKETS)
    buckets.upsert_buckets(spark, path, first, now(), BUCKETS)
    return path


@query("lead_upsert_in_buckets", f"{q.with_ctes(*INGEST_SQL, VALID_SQL, STORED_SQL, *_BATCH_SQL)} {printable_sql('after')}")
def lead_upsert_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a batch of a hundredth of the arrivals, which rewrites only the buckets it touches."""
    arrivals = arrived(spark, sf_dir)
    batch = F.coalesce(F.expr(_BATCH), F.lit(False))
    path = bucketed(spark, sf_dir, arrivals, arrivals.where(~batch))
    buckets.upsert_buckets(spark, path, arrivals.where(batch), dates.clock("2024-02-01T00:00:00Z"), BUCKETS)
    return printable(buckets.read_buckets(spark, path))


_WANTED = tuple(f"https://social.example/posts/user-{n % 7}_{n}" for n in (10, 20, 21, 63)) + ("https://social.example/posts/nobody_1",)


@query(
    "indexed_lookups",
    f"""{q.with_ctes(*UPSERT_SQL)} SELECT wanted.u AS wanted, 'post_url' AS by, author_name, {ts_text_sql('posted_at')} FROM (VALUES {', '.join(f'({q.lit(u)})' for u in _WANTED)}) AS wanted(u)
      JOIN merged ON post_url = wanted.u
    UNION ALL SELECT wanted.u, 'id', author_name, {ts_text_sql('posted_at')} FROM (VALUES {', '.join(f'({q.lit(u)})' for u in _WANTED)}) AS wanted(u) JOIN merged ON id = sha256(wanted.u)""",
)
def indexed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads found by URL in one bucket, and by id through Bloom filters."""
    arrivals = arrived(spark, sf_dir)
    path = bucketed(spark, sf_dir, arrivals, arrivals)
    found = []
    for url in _WANTED:
        ident = spark.range(1).select(merge.lead_id(F.lit(url)).alias("id")).first()["id"]
        for by, rows in (("post_url", buckets.lead_by_url(spark, path, url, BUCKETS)), ("id", buckets.lead_by_id(spark, path, ident))):
            found.append(rows.select(F.lit(url).alias("wanted"), F.lit(by).alias("by"), "author_name", ts_text("posted_at")))
    return reduce(DataFrame.unionAll, found)


@query(
    "upsert_tally",
    f"""{q.with_ctes(*UPSERT_SQL)} SELECT count_if(was_new) AS stored_new,
      (sum(arrivals) - count_if(was_new))::BIGINT AS stored_updated FROM merged""",
)
def upsert_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New leads and updates of a batch."""
    return merge.upsert_tally(merged_leads(spark, sf_dir))


@query(
    "need_tally",
    f"""{q.with_ctes(*UPSERT_SQL)}
    SELECT v.need, coalesce(f.n, 0)::BIGINT AS stored_new, (v.n - coalesce(f.n, 0))::BIGINT AS stored_updated
    FROM (SELECT need_category AS need, count(*) AS n FROM valid GROUP BY 1) v LEFT JOIN
      (SELECT first_need AS need, count(*) AS n FROM merged WHERE was_new GROUP BY 1) f ON v.need = f.need""",
)
def need_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New leads per need, each counted once across needs."""
    arrivals = arrived(spark, sf_dir)
    merged = merge.merge_arrivals(stored_leads(arrivals), merge.reduce_arrivals(arrivals), now())
    return merge.need_tally(arrivals, merged)


@query(
    "existing_rows",
    f"""{q.with_ctes(*INGEST_SQL, VALID_SQL, STORED_SQL)}
    SELECT v.seq, s.id AS stored_id, s.post_url IS NOT NULL AS existed FROM valid v LEFT JOIN stored s ON v.post_url = s.post_url""",
)
def existing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arrivals already have a stored row: one equi-join for the whole batch."""
    arrivals = arrived(spark, sf_dir)
    stored = stored_leads(arrivals).select("post_url", F.col("id").alias("stored_id"))
    joined = arrivals.select("seq", "post_url").join(stored, "post_url", "left")
    return joined.select("seq", "stored_id", F.col("stored_id").isNotNull().alias("existed"))


# --- rescoring, re-enriching -------------------------------------------------

RESCORED = (*UPSERT_SQL, *score_ctes("merged", "need_category"))


def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = merged_leads(spark, sf_dir).drop("was_new", "arrivals", "first_need")
    return score.score_leads(leads, now(), CFG)


def scored_leads(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the rescored leads, written down: every lead is merged and classified once.

    Otherwise a filter on the category repeats the classifier below the projection that lower-cases
    the texts, and a range partitioning samples all of it first.
    """
    return staged(rescored(spark, sf_dir).select(*columns), "scored")


@query(
    "rescored_leads",
    f"""{q.with_ctes(*RESCORED)} SELECT post_url, new_category AS category, fresh AS freshness_score,
      new_lead_score AS lead_score, 'scored' AS status FROM scored""",
)
def rescored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored lead scored at one clock."""
    return rescored(spark, sf_dir).select("post_url", "category", "freshness_score", "lead_score", "status")


ENRICHED_SQL = (
    "enriched",
    f"""SELECT post_url, coalesce(nullif(company, ''), {post_company_sql('post_text')}, {headline_company_sql('author_headline')}) AS company,
      coalesce(nullif(lower(regexp_extract(post_text, {EMAIL_SQL}, 0)), ''), contact_email) AS contact_email,
      coalesce({website_sql('post_text')}, website) AS website FROM merged""",
)


@query("reenriched_leads", f"{q.with_ctes(*UPSERT_SQL, ENRICHED_SQL)} SELECT * FROM enriched")
def reenriched_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leads re-enriched: company only filled, email and website replaced."""
    leads = score.enrich_leads(merged_leads(spark, sf_dir))
    return leads.select("post_url", "company", "contact_email", "website")


@query(
    "enrichment_tally",
    f"""{q.with_ctes(*UPSERT_SQL, ENRICHED_SQL)} SELECT count(*) AS total,
      count(nullif(company, '')) AS with_company, count(nullif(contact_email, '')) AS with_email,
      count(nullif(website, '')) AS with_website FROM enriched""",
)
def enrichment_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leads carry each fact."""
    return score.enrichment_tally(score.enrich_leads(merged_leads(spark, sf_dir)))


@query(
    "category_tally",
    f"""{q.with_ctes(*RESCORED)} SELECT listed.pos, listed.category, count(s.post_url) AS n,
      listed.category = 'client_lead' AS kept FROM {category_list_sql()} LEFT JOIN scored s
      ON s.new_category = listed.category GROUP BY ALL""",
)
def category_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads per category, zeros included."""
    return score.category_tally(spark, rescored(spark, sf_dir))


# --- ranking ------------------------------------------------------------------

_CUTOFF_SQL = f"{NOW_SQL} - to_days(30)"
_RANK = "new_lead_score DESC NULLS LAST, first_seen DESC, id ASC"


def cutoff():
    return dates.age_cutoff(now(), 30)


@query(
    "ranked_leads",
    f"""{q.with_ctes(*RESCORED)} SELECT author_name, new_lead_score AS lead_score, new_category AS category, need_text,
      post_url, {ts_text_sql('posted_at')}, platform FROM scored
    WHERE new_category = 'client_lead' AND coalesce(posted_at, first_seen) >= {_CUTOFF_SQL} ORDER BY {_RANK} LIMIT 20""",
)
def ranked_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outreach list: best client leads of the last 30 days, top 20."""
    leads = scored_leads(spark, sf_dir, *rank.EXPORT_COLUMNS, "first_seen", "id")
    top = rank.ranked(leads, cutoff=cutoff(), limit=20)
    return top.select(*rank.EXPORT_COLUMNS).withColumn("posted_at", ts_text("posted_at"))


@query(
    "ranked_positions",
    f"""{q.with_ctes(*RESCORED)} SELECT post_url, new_lead_score AS lead_score FROM scored ORDER BY {_RANK} LIMIT 50 OFFSET 25""",
)
def ranked_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the ranking over all categories."""
    ranked = rank.page(rescored(spark, sf_dir), rank.rank_order(), limit=50, offset=25)
    return ranked.select("post_url", "lead_score")


@query(
    "deep_page",
    f"""{q.with_ctes(*RESCORED, ('placed', f'SELECT post_url, new_lead_score AS lead_score, row_number() OVER (ORDER BY {_RANK}) - 1 AS place, count(*) OVER () AS n FROM scored'))}
    SELECT post_url, lead_score, place FROM placed WHERE place >= n // 10 AND place < n // 10 + 40""",
)
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rows of the ranking from a tenth of the table on, cut out by global rank."""
    leads = staged(rescored(spark, sf_dir).select("post_url", "lead_score", "first_seen", "id"), "scored")
    first = leads.count() // 10
    placed = rank.numbered(leads, rank.rank_order(), first, first + 40)
    return placed.select("post_url", "lead_score", F.col("position").cast("bigint").alias("place"))


@query(
    "recent_leads",
    f"""{q.with_ctes(*UPSERT_SQL)} SELECT post_url, {ts_text_sql('first_seen')} FROM merged
      ORDER BY merged.first_seen DESC, id ASC LIMIT 40""",
)
def recent_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most recently captured leads first."""
    return rank.most_recent(merged_leads(spark, sf_dir), 40).select("post_url", ts_text("first_seen"))


@query(
    "filtered_count",
    f"""{q.with_ctes(*RESCORED)} SELECT count(*) AS n FROM scored
      WHERE new_category = 'job_posting' AND coalesce(posted_at, first_seen) >= {_CUTOFF_SQL}""",
)
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a category and an age filter."""
    return rank.count_matching(scored_leads(spark, sf_dir, "category", "posted_at", "first_seen"), "job_posting", cutoff())


@query("row_count", f"{q.with_ctes(*UPSERT_SQL)} SELECT count(*) AS n FROM merged")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the lead table after the batch."""
    return rank.count_rows(merged_leads(spark, sf_dir))


@query(
    "point_lookups",
    """SELECT 'orders' AS t, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey = 42
    UNION ALL SELECT 'events', count(*), min(event_id) FROM events WHERE user_id = 7 AND event_type = 'error'""",
)
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by one key and by a pair of keys; the predicates reach the scan."""
    one = rank.lookup(table(spark, sf_dir, "orders"), o_orderkey=42)
    two = rank.lookup(table(spark, sf_dir, "events"), user_id=7, event_type="error")
    first = one.agg(F.lit("orders").alias("t"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))
    second = two.agg(F.lit("events").alias("t"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_key"))
    return first.unionByName(second)


@query(
    "all_but_the_first_leads",
    f"""{q.with_ctes(*RESCORED)} SELECT post_url, new_lead_score AS lead_score FROM scored ORDER BY {_RANK} OFFSET 25""",
)
def all_but_the_first_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lead after the first 25 of the ranking, without a limit."""
    leads = scored_leads(spark, sf_dir, "post_url", "lead_score", "first_seen", "id")
    return rank.page(leads, rank.rank_order(), offset=25).select("post_url", "lead_score")


_LOOKED_UP = "https://social.example/posts/user-3_10"


@query(
    "lead_lookups",
    f"""{q.with_ctes(*UPSERT_SQL, ATTEMPTS_SQL)} SELECT 'post_url' AS by, count(*) AS n, min(post_url) AS found FROM merged WHERE post_url = '{_LOOKED_UP}'
    UNION ALL SELECT 'id', count(*), min(post_url) FROM merged WHERE id = sha256('{_LOOKED_UP}')
    UNION ALL SELECT 'source, query', count(DISTINCT url), min(url) FROM attempts
      WHERE outcome = 'ok' AND source = 'src1' AND query = {q.lit(NEEDS[2])}""",
)
def lead_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by URL and by id, progress by source and query."""
    leads = merged_leads(spark, sf_dir).select("id", "post_url")
    progress = runs.seen_urls(attempts(spark, sf_dir))
    found = {
        "post_url": rank.lookup(leads, post_url=_LOOKED_UP).select("post_url"),
        "id": leads.where(F.col("id") == merge.lead_id(F.lit(_LOOKED_UP))).select("post_url"),
        "source, query": rank.lookup(progress, source="src1", query=NEEDS[2]).select("url"),
    }
    counted = [
        rows.agg(F.lit(by).alias("by"), F.count(F.lit(1)).alias("n"), F.min(rows.columns[0]).alias("found"))
        for by, rows in found.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(
    "posts_read_from_files",
    f"""{q.with_ctes(POSTS_SQL)} SELECT source, count(*) AS n, count(posted_at) AS dated, sum(length(post_text))::BIGINT AS characters
    FROM posts GROUP BY source""",
)
def posts_read_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts landed as files and read back in the declared schema."""
    path = work_dir(spark, "raw")
    raw_posts(spark, sf_dir).write.parquet(path)
    return read_raw_posts(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("data.posted_at").alias("dated"), F.sum(F.length("data.post_text")).alias("characters")
    )


@query(
    "export_rows",
    rf"""{q.with_ctes(*RESCORED)} SELECT author_name, new_lead_score AS lead_score, new_category AS category, need_text,
      post_url, coalesce(strftime(posted_at, '%Y-%m-%dT%H:%M:%S') || '+00:00', '') AS posted_at, platform
    FROM scored WHERE new_category = 'client_lead'""",
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the export file: ISO time stamps, missing ones as empty cells."""
    return export_view(rank.ranked(rescored(spark, sf_dir)))


@query(
    "exported_file",
    rf"""{q.with_ctes(*RESCORED)} SELECT author_name, new_lead_score::VARCHAR AS lead_score, new_category AS category, need_text,
      post_url, strftime(posted_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS posted_at, platform
    FROM scored WHERE coalesce(posted_at, first_seen) >= {_CUTOFF_SQL}""",
)
def exported_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export of all categories, written and read back; empty cells come back as NULL."""
    path = work_dir(spark, "export")
    export_leads(rescored(spark, sf_dir), path, category="all", cutoff=cutoff())
    columns = ", ".join(f"{c} STRING" for c in rank.EXPORT_COLUMNS)
    return spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)


@query(
    "explained_file",
    rf"""{q.with_ctes(*RESCORED)} SELECT post_url, new_lead_score::BIGINT AS lead_score, fresh::BIGINT AS freshness,
      need_score::BIGINT AS need_match FROM scored WHERE new_category = 'client_lead' AND fresh >= 40""",
)
def explained_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records with breakdown, written and read back."""
    path = work_dir(spark, "explained")
    leads = rank.at_least_fresh(score.explain_scores(rescored(spark, sf_dir), now(), CFG), 40)
    export_explained(leads, path)
    schema = "post_url STRING, lead_score LONG, breakdown STRUCT<freshness: LONG, need_match: LONG>"
    return spark.read.schema(schema).json(path).select("post_url", "lead_score", "breakdown.*")


# --- other joins and rewrites ---------------------------------------------------


@query(
    "unstored_candidates",
    f"""{q.with_ctes(*INGEST_SQL, VALID_SQL, STORED_SQL)}
    SELECT DISTINCT post_url AS url FROM folded WHERE post_url NOT IN (SELECT post_url FROM stored)""",
)
def unstored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate URLs that no earlier run stored, each once."""
    from workload.views import posts

    candidates = posts(spark, sf_dir).select(F.col("post_url").alias("url")).distinct()
    return discover.not_stored(candidates, stored_leads(clean_posts(spark, sf_dir)))


@query(
    "snapshot_backfill",
    """SELECT doc_id::VARCHAR AS id, 'unclear' AS category, 0 AS data_quality_score, '' AS quality_flags, 0 AS freshness_score,
      'new' AS status, NULL::VARCHAR AS contact_email, NULL::INTEGER AS lead_score, length(text) AS n FROM documents""",
)
def snapshot_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older layout read with the current schema: defaults and NULLs filled in."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("post_text"),
        F.lit(None).cast("int").alias("freshness_score"),
    )
    full = merge.backfill(old)
    return full.select(
        "id",
        "category",
        "data_quality_score",
        F.array_join("quality_flags", ",").alias("quality_flags"),
        "freshness_score",
        "status",
        "contact_email",
        "lead_score",
        F.char_length("post_text").cast("bigint").alias("n"),
    )


@query(
    "rows_after_delete",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
    UNION ALL SELECT -s_suppkey - 1, NULL FROM supplier""",
)
def rows_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete by key as an anti-join rewrite, insert as an append by name."""
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kept = merge.delete_keys(orders, gone, "o_custkey")
    extra = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("o_orderkey"))
    return merge.insert_rows(kept.select("o_orderkey", "o_custkey"), extra)


__all__ = ["SEEN_SQL"]
