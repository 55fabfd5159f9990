"""Saved post pages to typed posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needwell.config import Platform
from needwell.functions import html as h
from needwell.functions.text import blank_to_null


def parse_pages(pages: DataFrame, platform: Platform = Platform()) -> DataFrame:
    """Adds the post fields and ``outcome`` (ok, blocked, parse_error) to pages(url, html).

    All reading is column work on the page; only text that holds entities takes
    the Arrow path. Further columns of the input are kept, ``html`` is dropped.
    """
    keep = [c for c in pages.columns if c != "html"]
    raw = (
        pages.withColumn("_html", h.without_comments(F.coalesce(F.col("html"), F.lit(""))))
        .withColumn("_metas", h.meta_tags(F.col("_html")))
        .withColumn("_og_title", h.meta_content(F.col("_metas"), "og:title"))
        .withColumn("_og_description", h.meta_content(F.col("_metas"), "og:description"))
        .withColumn("_title", h.page_title(F.col("_html")))
    )
    no_meta = F.col("_og_title").isNull() & F.col("_og_description").isNull()
    decoded = raw.withColumns(
        {
            "_body": blank_to_null(
                h.decode_entities(F.when(no_meta, h.main_text(F.col("_html"))))
            ),
            "_og_title": blank_to_null(h.decode_entities(F.col("_og_title"))),
            "_og_description": blank_to_null(h.decode_entities(F.col("_og_description"))),
            "_title": h.decode_entities(F.col("_title")),
            "author_headline": h.decode_entities(h.author_headline(F.col("_html"))),
        }
    )
    wall = h.is_wall(F.col("_title"), F.col("_og_title"), F.col("_og_description"), platform)
    named = h.split_named_body(F.col("_og_description"), platform.label)
    parsed = decoded.withColumn("_named", named).withColumns(
        {
            "_wall": wall,
            "post_text": F.coalesce("_named.body", "_og_description", "_og_title", "_body"),
            "author_name": F.coalesce(
                F.when(h.plausible_name(F.col("_named.name")), F.col("_named.name")),
                h.author_from_slug(F.col("url")),
            ),
            "author_profile_url": h.first_profile_url(F.col("_html"), platform),
            "posted_at": h.posted_at(F.col("_html")),
        }
    )
    complete = F.col("author_name").isNotNull() & F.col("post_text").isNotNull()
    outcome = F.when(F.col("_wall"), h.BLOCKED).when(~complete, h.PARSE_ERROR).otherwise(h.OK)
    fields = ("author_name", "author_headline", "author_profile_url", "post_text", "posted_at")
    staged = parsed.withColumn("outcome", outcome)
    return staged.select(
        *keep,
        "outcome",
        *[F.when(F.col("outcome") == h.OK, F.col(f)).alias(f) for f in fields],
    )


def posts_from_pages(parsed: DataFrame, source: str, platform: Platform = Platform()) -> DataFrame:
    """Successful pages as raw posts; expects ``need``, ``seq`` and ``fetched_at``."""
    return parsed.where(F.col("outcome") == h.OK).select(
        F.lit(source).alias("source"),
        F.col("url").alias("source_url"),
        "fetched_at",
        "need",
        "seq",
        F.struct(
            "author_name",
            "author_headline",
            "author_profile_url",
            "post_text",
            "posted_at",
            F.lit(platform.name).alias("platform"),
        ).alias("data"),
    )
