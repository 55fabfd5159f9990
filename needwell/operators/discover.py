"""Candidate URLs of a run: first rank wins, known URLs drop out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_candidates(*parts: DataFrame) -> DataFrame:
    """All candidate sets together, by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_ranked(
    candidates: DataFrame,
    keys: tuple[str, ...] = ("source", "query"),
    order: tuple[str, ...] = ("term_pos", "rank"),
) -> DataFrame:
    """One row per URL and run at its best position.

    The minimum position per URL combines before the shuffle, so a URL that
    fills a third of all results stays cheap.
    """
    position = F.min(F.struct(*order)).alias("_position")
    best = candidates.groupBy(*keys, "url").agg(position)
    return best.select(*keys, "url", *[F.col(f"_position.{c}").alias(c) for c in order])


def not_seen(candidates: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("source", "query")) -> DataFrame:
    """Candidates without the URLs a run already extracted."""
    return candidates.join(seen.select(*keys, "url").distinct(), [*keys, "url"], "left_anti")


def not_stored(candidates: DataFrame, leads: DataFrame) -> DataFrame:
    """Candidates without the posts that any run has stored."""
    return candidates.join(leads.select(F.col("post_url").alias("url")).distinct(), "url", "left_anti")
