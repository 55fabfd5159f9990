"""Data-quality score and flags of a cleaned post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from needwell.functions.urls import is_valid_url

# Points per field; the full points add up to 100.
POINTS_AUTHOR, POINTS_AUTHOR_DOUBTFUL = 25, 15
POINTS_TEXT, POINTS_TEXT_SHORT = 25, 10
POINTS_POSTED_AT = 15
POINTS_PROFILE, POINTS_PROFILE_INVALID = 15, 5
POINTS_HEADLINE = 10
POINTS_COMPANY = 10
TEXT_MIN_LENGTH = 20


def _filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def quality(
    author_name: Column,
    low_confidence: Column,
    headline: Column,
    company: Column,
    post_text: Column,
    posted_at: Column,
    profile_url: Column,
) -> Column:
    """STRUCT(score INT, flags ARRAY<STRING>); each field adds points or explains why not."""
    long_enough = F.char_length(post_text) >= TEXT_MIN_LENGTH
    ladders = [
        # (condition, points, flag) per field; the first true row counts
        [
            (_filled(author_name) & ~low_confidence, POINTS_AUTHOR, None),
            (_filled(author_name), POINTS_AUTHOR_DOUBTFUL, "author_name_low_confidence"),
            (F.lit(True), 0, "missing_author_name"),
        ],
        [
            (_filled(post_text) & long_enough, POINTS_TEXT, None),
            (_filled(post_text), POINTS_TEXT_SHORT, "post_text_short"),
            (F.lit(True), 0, "missing_post_text"),
        ],
        [
            (posted_at.isNotNull(), POINTS_POSTED_AT, None),
            (F.lit(True), 0, "missing_posted_at"),
        ],
        [
            (_filled(profile_url) & is_valid_url(profile_url), POINTS_PROFILE, None),
            (_filled(profile_url), POINTS_PROFILE_INVALID, "invalid_author_profile_url"),
            (F.lit(True), 0, "missing_author_profile_url"),
        ],
        [
            (_filled(headline), POINTS_HEADLINE, None),
            (F.lit(True), 0, "missing_headline"),
        ],
        [
            (_filled(company), POINTS_COMPANY, None),
            (F.lit(True), 0, "missing_company"),
        ],
    ]
    points, flags = [], []
    for ladder in ladders:
        point = flag = None
        for condition, worth, label in ladder:
            point = (F.when if point is None else point.when)(condition, F.lit(worth))
            value = F.lit(label).cast("string")
            flag = (F.when if flag is None else flag.when)(condition, value)
        points.append(point)
        flags.append(flag)
    total = points[0]
    for point in points[1:]:
        total = total + point
    return F.struct(
        total.cast("int").alias("score"),
        F.filter(F.array(*flags), lambda f: f.isNotNull()).alias("flags"),
    )
