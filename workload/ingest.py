"""Mapping, validation, quality, classification and scoring of the derived posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.config import CATEGORIES, ScoringConfig
from needwell.functions import classify, dates, lexicon, quality, scoring, text
from needwell.operators import ingest
from needwell.operators.score import explain_scores, with_factors
from needwell.sources.posts import enabled_sources
from workload import dialect as q
from workload.registry import query, table
from workload.text import (
    EMAIL_SQL,
    doubtful_sql,
    headline_company_sql,
    name_sql,
    post_company_sql,
    tokens_sql,
    website_sql,
)
from workload.views import FOLDED_SQL, NOW_SQL, PLATFORM, now, posts, raw_posts, ts_text, ts_text_sql

# --- the ingest pass as SQL --------------------------------------------------

_RAW_POST = "CASE WHEN follows THEN raw_sentence || ' ' || doc_text ELSE raw_sentence END"
_EXCERPT = f"substr({q.strip(_RAW_POST)}, 1, 500)"
_FOLDED_EXCERPT = (
    f"CASE WHEN raw_sentence = '' THEN {_EXCERPT} ELSE replace({_EXCERPT}, {q.strip('raw_sentence')}, {q.strip('sentence')}) END"
)

MAPPED_SQL = (
    "mapped",
    f"""
  SELECT seq, source, post_url, need AS need_category, posted_at,
         'linkedin_public' AS platform,
         {name_sql('author_name')} AS author_name,
         nullif({q.collapse('author_headline')}, '') AS author_headline,
         nullif({q.strip('author_profile_url')}, '') AS author_profile_url,
         nullif({q.collapse(headline_company_sql('author_headline'))}, '') AS headline_company,
         {q.collapse(_FOLDED_EXCERPT)} AS need_clean,
         {q.collapse('post_text')} AS post_text,
         {q.strip('author_name')} = '' OR {q.strip(_RAW_POST)} = '' AS incomplete
  FROM folded""",
)

_PROFILE_OK = r"regexp_matches(author_profile_url, '(?i)^https?://[^/?#]+')"
_LADDERS = [
    [
        (f"author_name <> '' AND NOT {doubtful_sql('author_name')}", 25, None),
        ("author_name <> ''", 15, "author_name_low_confidence"),
        ("TRUE", 0, "missing_author_name"),
    ],
    [
        ("post_text <> '' AND length(post_text) >= 20", 25, None),
        ("post_text <> ''", 10, "post_text_short"),
        ("TRUE", 0, "missing_post_text"),
    ],
    [("posted_at IS NOT NULL", 15, None), ("TRUE", 0, "missing_posted_at")],
    [
        (f"author_profile_url IS NOT NULL AND {_PROFILE_OK}", 15, None),
        ("author_profile_url IS NOT NULL", 5, "invalid_author_profile_url"),
        ("TRUE", 0, "missing_author_profile_url"),
    ],
    [("author_headline IS NOT NULL", 10, None), ("TRUE", 0, "missing_headline")],
    [("headline_company IS NOT NULL", 10, None), ("TRUE", 0, "missing_company")],
]


def _case(ladder, index: int) -> str:
    values = [(r[0], str(r[1]) if index == 1 else q.lit(r[2])) for r in ladder]
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in values) + " END"


TAGGED_SQL = (
    "tagged",
    f"""
  SELECT *, ({' + '.join(_case(ladder, 1) for ladder in _LADDERS)})::INTEGER AS data_quality_score,
         list_filter([{', '.join(_case(ladder, 2) for ladder in _LADDERS)}], lambda f: f IS NOT NULL) AS quality_flags,
         CASE WHEN incomplete THEN 'mapping' WHEN author_name = '' OR post_text = '' THEN 'validation' END AS stage,
         CASE WHEN incomplete THEN 'missing author_name/post_text for ' || post_url
              WHEN author_name = '' THEN 'author name empty after cleaning'
              WHEN post_text = '' THEN 'post text empty after cleaning' END AS reason,
         coalesce(nullif(need_clean, ''), post_text) AS need_text,
         coalesce(headline_company, {post_company_sql('post_text')}, {headline_company_sql('author_headline')}) AS company,
         nullif(lower(regexp_extract(post_text, {EMAIL_SQL}, 0)), '') AS contact_email,
         {website_sql('post_text')} AS website
  FROM mapped""",
)
VALID_SQL = ("valid", "SELECT * FROM tagged WHERE reason IS NULL")
INGEST_SQL = (FOLDED_SQL, MAPPED_SQL, TAGGED_SQL)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.tag_posts(raw_posts(spark, sf_dir), PLATFORM)


def clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid arrivals of the derived posts."""
    return ingest.valid_rows(tagged(spark, sf_dir))


@query("mapping_rejects", f"{q.with_ctes(*INGEST_SQL)} SELECT seq, reason FROM tagged WHERE stage = 'mapping'")
def mapping_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an author or a text."""
    mapped = ingest.map_posts(raw_posts(spark, sf_dir), PLATFORM)
    return mapped.where(F.col("reject_stage") == ingest.MAPPING).select("seq", F.col("reject_reason").alias("reason"))


@query("validation_rejects", f"{q.with_ctes(*INGEST_SQL)} SELECT seq, reason FROM tagged WHERE stage = 'validation'")
def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that cleaning left without an author or a text."""
    rows = tagged(spark, sf_dir).where(F.col("reject_stage") == ingest.VALIDATION)
    return rows.select("seq", F.col("reject_reason").alias("reason"))


@query(
    "reject_sink_rows",
    f"""{q.with_ctes(*INGEST_SQL)}
    SELECT source, stage, reason, post_url AS source_url, count(*) AS n FROM tagged
    WHERE reason IS NOT NULL GROUP BY ALL""",
)
def reject_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the reject table; payload presence is part of the count."""
    rows = ingest.reject_rows(tagged(spark, sf_dir), now()).where(F.size("raw_data") > 0)
    return rows.groupBy("source", "stage", "reason", "source_url").agg(F.count(F.lit(1)).alias("n"))


_ARRIVAL_SQL = f"""SELECT seq, post_url, author_name, author_profile_url, author_headline, company, contact_email,
    website, need_text, need_category, post_text, {ts_text_sql('posted_at')}, platform, data_quality_score,
    array_to_string(quality_flags, ',') AS quality_flags FROM valid"""


@query("assessed_posts", f"{q.with_ctes(*INGEST_SQL, VALID_SQL)} {_ARRIVAL_SQL}")
def assessed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full ingest pass: every column of every valid row."""
    rows = clean_posts(spark, sf_dir)
    return rows.withColumns(
        {"posted_at": ts_text("posted_at"), "quality_flags": F.array_join("quality_flags", ",")}
    )


@query(
    "data_quality",
    f"""{q.with_ctes(*INGEST_SQL)}
    SELECT seq, data_quality_score AS score, array_to_string(quality_flags, ',') AS flags FROM tagged""",
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and flags of all rows, rejected ones included."""
    rows = ingest.assess_posts(ingest.map_posts(raw_posts(spark, sf_dir), PLATFORM))
    score = quality.quality(
        F.col("author_name"),
        text.name_low_confidence(F.col("author_name")),
        F.col("author_headline"),
        F.col("company"),
        F.col("post_text"),
        F.col("posted_at"),
        F.col("author_profile_url"),
    )
    scored = rows.select("seq", score.alias("q"))
    return scored.select("seq", F.col("q.score").alias("score"), F.array_join("q.flags", ",").alias("flags"))


@query(
    "mixed_timestamps",
    r"""SELECT event_id, epoch_us(CASE WHEN event_id % 3 = 0 THEN ts::VARCHAR::TIMESTAMP END) AS micros FROM events""",
)
def mixed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text posted_at values: unreadable ones become NULL."""
    e = F.col("event_id")
    value = F.when(e % 3 == 0, F.col("ts").cast("string")).when(e % 3 == 1, "yesterday").otherwise(F.lit(""))
    events = table(spark, sf_dir, "events").select("event_id", value.alias("posted_at"))
    read = ingest.as_timestamp(F.col("posted_at"), events.schema["posted_at"].dataType)
    return events.select("event_id", F.unix_micros(read).alias("micros"))


@query(
    "enabled_documents",
    "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src3') GROUP BY source",
)
def enabled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of enabled sources, the predicate reaching the scan."""
    rows = enabled_sources(table(spark, sf_dir, "documents"), ("src1", " src3 "))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- classification ---------------------------------------------------------

CLEAN_SQL = (
    "clean",
    f"SELECT seq, {name_sql('author_name')} AS author_name, {q.collapse('post_text')} AS post_text, need, posted_at FROM folded",
)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean author, text, need and time of every derived post."""
    p = posts(spark, sf_dir)
    folded = p.withColumns({c: text.fold_text(F.col(c)) for c in ("author_name", "post_text")})
    return folded.select(
        "seq",
        text.tidy_author_name(F.col("author_name")).alias("author_name"),
        text.tidy(F.col("post_text")).alias("post_text"),
        "need",
        "posted_at",
    )


def _lowered(rows: DataFrame) -> DataFrame:
    """Lower-cased once, in columns that all groups are searched in."""
    return rows.withColumns({c: classify.lowered(F.col(c)) for c in ("author_name", "post_text")})


_GROUP_COLUMN = {name: "author_name" if name == "company_author" else "post_text" for name in lexicon.GROUPS}


@query(
    "signal_groups",
    q.with_ctes(FOLDED_SQL, CLEAN_SQL)
    + "SELECT seq, "
    + ", ".join(f"{q.matches_any(_GROUP_COLUMN[n], p)} AS {n}" for n, p in lexicon.GROUPS.items())
    + " FROM clean",
)
def signal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the eight signal groups occur, over whole posts."""
    rows = _lowered(cleaned(spark, sf_dir))
    return rows.select("seq", *[classify.occurs(F.col(_GROUP_COLUMN[n]), p).alias(n) for n, p in lexicon.GROUPS.items()])


def hits_sql(column: str, patterns) -> str:
    """First matches of a group, joined by a bar."""
    firsts = ", ".join(
        f"trim(regexp_replace(regexp_extract(lower({column}), {q.lit(q.re2_capture(p))}, 1), '\\s+', ' ', 'g'))"
        for p in patterns
    )
    hits = f"list_filter([{firsts}], lambda h: h <> '')"
    return f"array_to_string(list_filter({hits}, lambda h, i: list_position({hits}, h) = i), '|')"


@query(
    "signal_hits",
    q.with_ctes(FOLDED_SQL, CLEAN_SQL)
    + "SELECT seq, "
    + ", ".join(f"{hits_sql(_GROUP_COLUMN[n], p)} AS {n}" for n, p in lexicon.GROUPS.items())
    + " FROM clean",
)
def signal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched wording of each group."""
    rows = _lowered(cleaned(spark, sf_dir))
    signals = rows.select("seq", classify.all_signals_lowered(F.col("post_text"), F.col("author_name")).alias("s"))
    return signals.select("seq", *[F.array_join(f"s.{n}", "|").alias(n) for n in lexicon.GROUPS])


def request_sql(column: str) -> str:
    return (
        f"({q.matches_any(column, lexicon.TARGET)} AND ({q.matches_any(column, lexicon.REQUEST)} "
        f"OR {q.matches_any(column, lexicon.CALL_TO_ACTION)}))"
    )


def category_sql(column: str, author: str) -> str:
    return f"""CASE WHEN {q.matches_any(column, lexicon.JOB)} THEN 'job_posting'
      WHEN {q.matches_any(column, lexicon.RECRUITER)} THEN 'recruiter_staffing'
      WHEN {q.matches_any(author, lexicon.COMPANY_AUTHOR)} OR {q.matches_any(column, lexicon.SELF_PROMOTION)} THEN 'competitor_selfpromo'
      WHEN {q.matches_any(column, lexicon.CONTENT_NOISE)} THEN 'content_noise'
      WHEN {request_sql(column)} THEN 'client_lead' ELSE 'unclear' END"""


@query(
    "post_categories",
    f"""{q.with_ctes(FOLDED_SQL, CLEAN_SQL)}
    SELECT seq, {category_sql('post_text', 'author_name')} AS category, {request_sql('post_text')} AS has_request,
      ({category_sql('post_text', 'author_name')}) = 'client_lead' AS is_client FROM clean""",
)
def post_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category by precedence, whether a request is there, and the client flag."""
    rows = cleaned(spark, sf_dir).select(
        "seq",
        classify.category(F.col("post_text"), F.col("author_name")).alias("category"),
        classify.has_request(F.col("post_text")).alias("has_request"),
    )
    return rows.withColumn("is_client", classify.is_client(F.col("category")))


@query(
    "conversation_categories",
    f"""WITH c AS (SELECT conv_id, role, {q.collapse('text')} AS t FROM conversations)
    SELECT role, {category_sql('t', "'Maria'")} AS category, count(*) AS turns FROM c GROUP BY ALL""",
)
def conversation_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same classifier over whole conversation turns."""
    turns = table(spark, sf_dir, "conversations").withColumn("t", text.clean_text(F.col("text")))
    tagged_turns = turns.select("role", classify.category(F.col("t"), F.lit("Maria")).alias("category"))
    return tagged_turns.groupBy("role", "category").agg(F.count(F.lit(1)).alias("turns"))


# --- scoring ----------------------------------------------------------------

CFG = ScoringConfig()
TUNED = ScoringConfig.overlay(
    {"scoring": {"freshness_half_life_days": 2, "weight_need_match": 1, "non_client_score_cap": 5, "unknown": "x"}}
)


def freshness_sql(posted: str, seen: str, half_life: float = 4.0, penalty: float = 0.6) -> str:
    age = f"greatest(0.0::DOUBLE, (epoch({NOW_SQL}) - epoch(coalesce({posted}, {seen})))::DOUBLE / 86400.0::DOUBLE)"
    raw = f"100.0::DOUBLE * pow(0.5::DOUBLE, {age} / {half_life}::DOUBLE) * CASE WHEN {posted} IS NULL THEN {penalty}::DOUBLE ELSE 1.0::DOUBLE END"
    return f"least(100, greatest(0, round_even({raw}, 0)))::INTEGER"


@query(
    "freshness_scores",
    f"""{q.with_ctes(FOLDED_SQL)}
    SELECT seq, {freshness_sql('posted_at', "TIMESTAMP '2024-01-30'")} AS score, posted_at IS NULL AS used_fallback,
      greatest(0.0::DOUBLE, (epoch({NOW_SQL}) - epoch(coalesce(posted_at, TIMESTAMP '2024-01-30')))::DOUBLE / 86400.0::DOUBLE) AS age_days
    FROM folded""",
)
def freshness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential decay with the first-seen fallback."""
    p = posts(spark, sf_dir)
    seen = dates.clock("2024-01-30T00:00:00Z")
    details = scoring.freshness_details(F.col("posted_at"), seen, now(), CFG)
    return p.select("seq", details.alias("f")).select("seq", "f.*")


def need_columns_sql(need: str, column: str) -> str:
    """Select list with the parts of a need match: tok, matched, full_phrase, asks."""
    words = rf"regexp_split_to_array(lower({column}), '[^{q.WORD}]+')"
    return f"""lower(trim({need})) AS phrase, {tokens_sql(need)} AS tok,
      len(list_filter({tokens_sql(need)}, lambda t: list_contains({words}, t))) AS matched,
      contains(lower({column}), lower(trim({need}))) AS full_phrase,
      {q.matches_any(column, lexicon.SOLICITATION)} AS asks"""


NEED_SCORE_SQL = """CASE WHEN len(tok) = 0 THEN 0 ELSE least(100, greatest(0, round_even(
    CASE WHEN full_phrase THEN 70.0::DOUBLE WHEN matched = len(tok) THEN 50.0::DOUBLE
         WHEN matched > 0 THEN 40.0::DOUBLE * (matched::DOUBLE / len(tok)) ELSE 10.0::DOUBLE END
    + CASE WHEN asks AND matched > 0 THEN CASE WHEN full_phrase OR matched = len(tok) THEN 30.0::DOUBLE ELSE 15.0::DOUBLE END
      ELSE 0.0::DOUBLE END, 0)))::INTEGER END"""


@query(
    "need_matches",
    f"""{q.with_ctes(FOLDED_SQL, CLEAN_SQL, ('m', f"SELECT seq, {need_columns_sql('need', 'post_text')} FROM clean WHERE post_text <> ''"))}
    SELECT seq, {NEED_SCORE_SQL} AS score, full_phrase, matched::INTEGER AS matched_tokens, len(tok)::INTEGER AS total_tokens,
      asks AND matched > 0 AS solicited FROM m""",
)
def need_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of each post to its need, with the parts of the score."""
    rows = cleaned(spark, sf_dir).where(F.col("post_text") != "")
    low = rows.withColumn("_low", classify.lowered(F.col("post_text")))
    return scoring.with_need_match(low, "_low", "need", "m", CFG).select("seq", "m.*")


@query(
    "solicitations",
    f"""{q.with_ctes(FOLDED_SQL, CLEAN_SQL)} SELECT seq, {q.matches_any('post_text', lexicon.SOLICITATION)} AS asks FROM clean""",
)
def solicitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose author is shopping for something."""
    return cleaned(spark, sf_dir).select("seq", scoring.solicited(F.col("post_text")).alias("asks"))


def score_ctes(source: str, need: str, cfg: ScoringConfig = CFG) -> tuple:
    """CTEs that add category, freshness, need score and lead score to a relation."""
    w1, w2, w3 = cfg.weights()
    parts = (
        "parts",
        f"""SELECT *, {category_sql('post_text', 'author_name')} AS new_category,
          {freshness_sql('posted_at', 'first_seen', cfg.freshness_half_life_days, cfg.freshness_fallback_penalty)} AS fresh,
          {need_columns_sql(need, 'post_text')} FROM {source}""",
    )
    needed = ("needed", f"SELECT *, {NEED_SCORE_SQL} AS need_score FROM parts")
    blend = f"({w1!r}::DOUBLE * fresh + {w2!r}::DOUBLE * need_score + {w3!r}::DOUBLE * data_quality_score)"
    scored = (
        "scored",
        f"""SELECT *, least(100, greatest(0, round_even(CASE WHEN new_category = 'client_lead' THEN {blend}
          ELSE least({blend}, {cfg.non_client_score_cap!r}::DOUBLE) END, 0)))::INTEGER AS new_lead_score FROM needed""",
    )
    return parts, needed, scored


def flat_leads(rows: DataFrame) -> DataFrame:
    """Arrivals read as stored leads at the first-seen clock."""
    return rows.withColumn("first_seen", dates.clock("2024-01-30T00:00:00Z"))


SEEN_SQL = ("seen", "SELECT *, TIMESTAMP '2024-01-30 00:00:00' AS first_seen FROM valid")


def _scores(rows: DataFrame, cfg: ScoringConfig) -> DataFrame:
    staged = with_factors(rows, now(), cfg)
    score = scoring.lead_score(
        F.col("_category"), F.col("_fresh.score"), F.col("_need.score"), F.col("data_quality_score"), cfg
    )
    return staged.select(
        "seq",
        F.col("_category").alias("category"),
        F.col("_fresh.score").alias("freshness"),
        F.col("_need.score").alias("need_match"),
        score.alias("lead_score"),
    )


_SCORES_SQL = "SELECT seq, new_category AS category, fresh AS freshness, need_score AS need_match, new_lead_score AS lead_score FROM scored"


@query(
    "lead_scores",
    f"{q.with_ctes(*INGEST_SQL, VALID_SQL, SEEN_SQL, *score_ctes('seen', 'need_category'))} {_SCORES_SQL}",
)
def lead_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blended score of every valid post."""
    return _scores(flat_leads(clean_posts(spark, sf_dir)), CFG)


@query(
    "lead_scores_tuned",
    f"{q.with_ctes(*INGEST_SQL, VALID_SQL, SEEN_SQL, *score_ctes('seen', 'need_category', TUNED))} {_SCORES_SQL}",
)
def lead_scores_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with overlaid settings: half-life, weights and cap."""
    return _scores(flat_leads(clean_posts(spark, sf_dir)), TUNED)


@query(
    "score_breakdowns",
    f"""{q.with_ctes(*INGEST_SQL, VALID_SQL, SEEN_SQL, *score_ctes('seen', 'need_category'))}
    SELECT seq, new_category AS category, fresh AS freshness, need_score AS need_match, data_quality_score AS data_quality,
      posted_at IS NULL AS used_fallback, new_category <> 'client_lead' AS capped, {request_sql('post_text')} AS has_request,
      {CFG.weights()[2]!r}::DOUBLE AS quality_weight, {hits_sql('post_text', lexicon.REQUEST)} AS request_signals FROM scored""",
)
def score_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each post scores what it scores."""
    rows = explain_scores(flat_leads(clean_posts(spark, sf_dir)), now(), CFG)
    b = F.col("breakdown")
    return rows.select(
        "seq",
        b["category"].alias("category"),
        b["freshness"].alias("freshness"),
        b["need_match"].alias("need_match"),
        b["data_quality"].alias("data_quality"),
        b["freshness_used_fallback"].alias("used_fallback"),
        b["non_client_capped"].alias("capped"),
        b["has_request"].alias("has_request"),
        b["weights"]["data_quality"].alias("quality_weight"),
        F.array_join(b["signals"]["request"], "|").alias("request_signals"),
    )


def category_list_sql() -> str:
    rows = ", ".join(f"({i}, {q.lit(c)})" for i, c in enumerate(CATEGORIES))
    return f"(VALUES {rows}) AS listed(pos, category)"


__all__ = ["Column", "ts_text"]
