"""Candidate URLs from saved search results, in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needwell.config import Platform
from needwell.functions.html import link_targets
from needwell.functions.urls import canonical_post_url, is_post_url, unwrap_redirect

# Where the two JSON shapes keep their result list and link.
ORGANIC_SHAPE = ("$.organic", "$.link")
WEB_SHAPE = ("$.web.results", "$.url")


def _json_links(payload: Column, shape: tuple[str, str]) -> Column:
    results, link = shape
    items = F.try_variant_get(F.try_parse_json(payload), results, "array<variant>")

    def text_only(item: Column) -> Column:
        value = F.try_variant_get(item, link, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, link, "string"))

    return F.transform(items, text_only)


def _unfold(df: DataFrame, links: Column) -> DataFrame:
    unfolded = df.select("*", F.posexplode(links).alias("rank", "url"))
    return unfolded.where(F.col("url").isNotNull())


def json_candidates(df: DataFrame, shape: tuple[str, str], payload: str = "payload") -> DataFrame:
    """One row per string link; a malformed payload gives no rows."""
    return _unfold(df, _json_links(F.col(payload), shape)).drop(payload)


def html_candidates(
    df: DataFrame, payload: str = "payload", platform: Platform = Platform()
) -> DataFrame:
    """One row per anchor target, redirects unwrapped."""
    unfolded = _unfold(df, link_targets(F.col(payload))).drop(payload)
    return unfolded.withColumn("url", unwrap_redirect(F.col("url"), platform))


def keep_post_urls(candidates: DataFrame, platform: Platform = Platform()) -> DataFrame:
    """Only post URLs, cut to their canonical form."""
    posts = candidates.where(is_post_url(F.col("url"), platform))
    return posts.withColumn("url", canonical_post_url(F.col("url")))
