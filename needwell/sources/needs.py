"""Needs and search terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.functions.text import strip


def distinct_needs(df: DataFrame, need: str = "need", pos: str = "pos") -> DataFrame:
    """Trimmed needs without blanks; case-insensitive repeats keep the first spelling.

    An aggregate instead of a window: equal spellings combine before the shuffle.
    """
    trimmed = df.select(strip(F.col(need)).alias("need"), F.col(pos).alias("pos"))
    return (
        trimmed.where(F.col("need") != "")
        .groupBy(F.lower("need").alias("need_key"))
        .agg(F.min_by("need", "pos").alias("need"), F.min("pos").alias("pos"))
        .select("pos", "need")
    )


def needs_table(spark: SparkSession, needs: Sequence[str]) -> DataFrame:
    """Configured needs as a table; an empty list is an error."""
    if not isinstance(needs, list | tuple) or not all(isinstance(n, str) for n in needs):
        raise ValueError("needs must be a list of strings")
    if not any(n.strip() for n in needs):
        raise ValueError("no needs defined")
    rows = spark.createDataFrame(list(enumerate(needs)), "pos INT, need STRING")
    return distinct_needs(rows)


def search_terms(needs: DataFrame, templates: Sequence[str]) -> DataFrame:
    """One row per need and template with ``{need}`` filled in.

    Templates are configuration, so they unfold from an array literal in place.
    """
    if not isinstance(templates, list | tuple) or not all(isinstance(t, str) for t in templates):
        raise ValueError("templates must be a list of strings")
    if not templates:
        raise ValueError("no query templates defined")
    unfolded = needs.select("*", F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("term_pos", "template"))
    return unfolded.withColumn(
        "term", F.replace(F.col("template"), F.lit("{need}"), strip(F.col("need")))
    ).drop("template")
