"""Raw posts to checked, cleaned, scored and enriched rows, rejects tagged in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needwell.config import Platform
from needwell.functions import contact, text
from needwell.functions.dates import parse_iso
from needwell.functions.quality import quality

# Stages and reasons of rejected rows.
MAPPING, VALIDATION = "mapping", "validation"
REASON_MAPPING = "missing author_name/post_text for "
REASON_NO_AUTHOR = "author name empty after cleaning"
REASON_NO_TEXT = "post text empty after cleaning"

# Columns an arriving post brings; score and lifecycle columns are not among them.
ARRIVAL_COLUMNS = (
    "post_url",
    "author_name",
    "author_profile_url",
    "author_headline",
    "company",
    "contact_email",
    "website",
    "need_text",
    "need_category",
    "post_text",
    "posted_at",
    "platform",
    "data_quality_score",
    "quality_flags",
)


def as_timestamp(value: Column, dtype: T.DataType) -> Column:
    """A TIMESTAMP from whatever the raw column holds; unreadable values are NULL."""
    if isinstance(dtype, T.TimestampType):
        return value
    if isinstance(dtype, T.TimestampNTZType | T.DateType):
        return value.cast("timestamp")
    if isinstance(dtype, T.StringType):
        return parse_iso(value)
    return F.lit(None).cast("timestamp")


def map_posts(raw: DataFrame, platform: Platform = Platform()) -> DataFrame:
    """Typed columns from ``data``; rows without author or text get a mapping reason."""
    data_type = raw.schema["data"].dataType
    has = set(data_type.fieldNames())

    def field(name: str) -> Column:
        return F.col(f"data.{name}") if name in has else F.lit(None).cast("string")

    mapped = raw.withColumns(
        {
            "author_name": text.strip(F.coalesce(field("author_name"), F.lit(""))),
            "post_text": text.strip(F.coalesce(field("post_text"), F.lit(""))),
            "author_headline": text.blank_to_null(field("author_headline")),
            "author_profile_url": text.blank_to_null(field("author_profile_url")),
            "posted_at": as_timestamp(F.col("data.posted_at"), data_type["posted_at"].dataType)
            if "posted_at" in has
            else F.lit(None).cast("timestamp"),
            "platform": F.coalesce(F.nullif(field("platform"), F.lit("")), F.lit(platform.name)),
            "post_url": F.col("source_url"),
            "need_category": F.col("need"),
        }
    )
    incomplete = (F.col("author_name") == "") | (F.col("post_text") == "")
    return mapped.withColumns(
        {
            "company": text.company_from_headline(F.col("author_headline")),
            "need_text": text.need_excerpt(F.col("post_text")),
            "reject_stage": F.when(incomplete, MAPPING),
            "reject_reason": F.when(incomplete, F.concat(F.lit(REASON_MAPPING), F.col("source_url"))),
        }
    )


def assess_posts(mapped: DataFrame) -> DataFrame:
    """Cleaned fields, validation reasons and the quality score (before enrichment)."""
    fields = ("author_name", "author_headline", "company", "need_text", "post_text")
    # one projection, so all five share a single Arrow round trip
    folded = mapped.withColumns({f: text.fold_text(F.col(f)) for f in fields})
    named = folded.withColumn("author_name", text.tidy_author_name(F.col("author_name")))
    reason = F.when(F.col("author_name") == "", REASON_NO_AUTHOR).when(
        ~text.has_content(F.col("post_text")), REASON_NO_TEXT
    )
    cleaned = named.withColumns(
        {
            "reject_reason": F.coalesce("reject_reason", reason),
            "reject_stage": F.coalesce("reject_stage", F.when(reason.isNotNull(), VALIDATION)),
            "author_headline": F.nullif(text.tidy(F.col("author_headline")), F.lit("")),
            "company": F.nullif(text.tidy(F.col("company")), F.lit("")),
            "need_text": text.tidy(F.col("need_text")),
            "post_text": text.tidy(F.col("post_text")),
        }
    )
    checked = cleaned.withColumns(
        {
            "need_text": F.coalesce(F.nullif(F.col("need_text"), F.lit("")), F.col("post_text")),
            "_quality": quality(
                F.col("author_name"),
                text.name_low_confidence(F.col("author_name")),
                F.col("author_headline"),
                F.col("company"),
                F.col("post_text"),
                F.col("posted_at"),
                F.col("author_profile_url"),
            ),
        }
    )
    return checked.withColumns(
        {
            "data_quality_score": F.col("_quality.score"),
            "quality_flags": F.col("_quality.flags"),
        }
    ).drop("_quality")


def enrich_posts(assessed: DataFrame) -> DataFrame:
    """Company filled where still missing, email and website from the post."""
    post, headline = F.col("post_text"), F.col("author_headline")
    return assessed.withColumns(
        {
            "company": F.coalesce("company", contact.company_name(post, headline)),
            "contact_email": contact.first_email(post),
            "website": contact.first_website(post),
        }
    )


def tag_posts(raw: DataFrame, platform: Platform = Platform()) -> DataFrame:
    """The whole ingest pass: every input row once, valid or tagged with a reason."""
    return enrich_posts(assess_posts(map_posts(raw, platform)))


def settled(tagged: DataFrame) -> DataFrame:
    """What valid and rejected rows are read from, to be written down once; only rejects carry their raw payload."""
    payload = F.when(F.col("reject_reason").isNotNull(), F.col("data")).alias("data")
    return tagged.select("seq", "source", "source_url", payload, "reject_stage", "reject_reason", *ARRIVAL_COLUMNS)


def valid_rows(tagged: DataFrame) -> DataFrame:
    """Rows ready to be stored, with their arrival order."""
    return tagged.where(F.col("reject_reason").isNull()).select("seq", *ARRIVAL_COLUMNS)


def reject_rows(tagged: DataFrame, now: Column) -> DataFrame:
    """Rejected rows with stage, reason, raw payload and URL."""
    data_type = tagged.schema["data"].dataType
    payload = F.map_filter(
        F.create_map(
            *[
                part
                for name in data_type.fieldNames()
                for part in (F.lit(name), F.col(f"data.{name}").cast("string"))
            ]
        ),
        lambda _, v: v.isNotNull(),
    )
    return tagged.where(F.col("reject_reason").isNotNull()).select(
        "source",
        F.col("reject_stage").alias("stage"),
        F.col("reject_reason").alias("reason"),
        payload.alias("raw_data"),
        "source_url",
        now.alias("created_at"),
    )
