"""Declared table schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()
_LIST = T.ArrayType(T.StringType())


def _struct(*fields: tuple) -> T.StructType:
    """Fields as (name, type) or (name, type, nullable)."""
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


POST_DATA = _struct(
    ("author_name", _S),
    ("author_headline", _S),
    ("author_profile_url", _S),
    ("post_text", _S),
    ("posted_at", _TS),
    ("platform", _S),
)

RAW_POSTS = _struct(
    ("source", _S, False),
    ("source_url", _S, False),
    ("fetched_at", _TS),
    ("need", _S, False),
    ("seq", _L, False),
    ("data", POST_DATA, False),
)

INTENT_LEADS = _struct(
    ("id", _S, False),
    ("author_name", _S, False),
    ("author_profile_url", _S),
    ("author_headline", _S),
    ("company", _S),
    ("contact_email", _S),
    ("website", _S),
    ("need_text", _S, False),
    ("need_category", _S, False),
    ("post_url", _S, False),
    ("post_text", _S, False),
    ("posted_at", _TS),
    ("platform", _S, False),
    ("freshness_score", _I, False),
    ("lead_score", _I),
    ("category", _S, False),
    ("suggested_angle", _S),
    ("data_quality_score", _I, False),
    ("quality_flags", _LIST, False),
    ("status", _S, False),
    ("lead_id", _S),
    ("first_seen", _TS, False),
    ("last_updated", _TS, False),
)

COMPANIES = _struct(
    ("id", _S, False),
    ("business_name", _S, False),
    ("website", _S),
    ("domain", _S),
    ("industry", _S),
    ("category", _S),
    ("description", _S),
    ("keywords", _LIST, False),
    ("services", _LIST, False),
    ("products", _LIST, False),
    ("country", _S),
    ("state", _S),
    ("city", _S),
    ("postal_code", _S),
    ("phone", _S),
    ("email", _S),
    ("linkedin_url", _S),
    ("instagram", _S),
    ("facebook", _S),
    ("twitter", _S),
    ("company_size", _S),
    ("employee_count_est", _I),
    ("founder", _S),
    ("ceo", _S),
    ("google_rating", T.DoubleType()),
    ("review_count", _I),
    ("business_hours", _S),
    ("tech_stack", _LIST, False),
    ("lead_source", _S, False),
    ("source_url", _S, False),
    ("data_quality_score", _I, False),
    ("lead_score", _I),
    ("status", _S, False),
    ("first_seen", _TS, False),
    ("last_updated", _TS, False),
)

REJECTS = _struct(
    ("source", _S, False),
    ("stage", _S, False),
    ("reason", _S, False),
    ("raw_data", T.MapType(_S, _S), False),
    ("source_url", _S),
    ("created_at", _TS, False),
)

RUNS = _struct(
    ("run_id", _S, False),
    ("source", _S, False),
    ("query", _S),
    ("status", _S, False),
    ("pages_visited", _L, False),
    ("leads_found", _L, False),
    ("rejects", _L, False),
    ("errors", _L, False),
    ("stored_new", _L, False),
    ("stored_updated", _L, False),
    ("started_at", _TS, False),
    ("finished_at", _TS),
    ("duration_seconds", T.DoubleType()),
    ("error_message", _S),
)

SEEN_URLS = _struct(("source", _S, False), ("query", _S, False), ("url", _S, False))

PAGES = _struct(("url", _S, False), ("html", _S))

# Defaults of columns that a new row, or a row of an older snapshot, may lack.
LEAD_DEFAULTS = {
    "freshness_score": 0,
    "category": "unclear",
    "data_quality_score": 0,
    "status": "new",
}
LEAD_LIST_DEFAULTS = ("quality_flags",)
