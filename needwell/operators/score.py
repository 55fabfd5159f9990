"""Re-scoring and re-enriching stored leads; narrow projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.config import CATEGORIES, ScoringConfig
from needwell.functions import classify, contact, scoring


def _with_lowered_factors(leads: DataFrame, now: Column, cfg: ScoringConfig) -> DataFrame:
    """Adds ``_category``, ``_fresh``, ``_need`` and the lower-cased ``_low`` and ``_low_author``."""
    lowered = leads.withColumns(
        {
            "_low": classify.lowered(F.col("post_text")),
            "_low_author": classify.lowered(F.col("author_name")),
        }
    )
    staged = scoring.with_need_match(lowered, "_low", "need_category", "_need", cfg)
    return staged.withColumns(
        {
            "_category": classify.category_lowered(F.col("_low"), F.col("_low_author")),
            "_fresh": scoring.freshness_details(F.col("posted_at"), F.col("first_seen"), now, cfg),
        }
    )


def with_factors(leads: DataFrame, now: Column, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Adds ``_category``, ``_fresh`` and ``_need`` to leads; the text is lower-cased once."""
    return _with_lowered_factors(leads, now, cfg).drop("_low", "_low_author")


def score_leads(leads: DataFrame, now: Column, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Category, freshness, lead score and status of every row at one clock."""
    staged = with_factors(leads, now, cfg)
    score = scoring.lead_score(
        F.col("_category"), F.col("_fresh.score"), F.col("_need.score"), F.col("data_quality_score"), cfg
    )
    return staged.withColumns(
        {
            "category": F.col("_category"),
            "freshness_score": F.col("_fresh.score"),
            "lead_score": score,
            "status": F.lit("scored"),
        }
    ).drop("_category", "_fresh", "_need")


def explain_scores(leads: DataFrame, now: Column, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Leads with a ``breakdown`` struct that shows where each score comes from."""
    breakdown = scoring.score_breakdown_lowered(
        F.col("_category"),
        F.col("_low"),
        F.col("_low_author"),
        F.col("_fresh"),
        F.col("_need.score"),
        F.col("data_quality_score"),
        cfg,
    )
    staged = _with_lowered_factors(leads, now, cfg).withColumn("breakdown", breakdown)
    return staged.drop("_low", "_low_author", "_category", "_fresh", "_need")


def enrich_leads(leads: DataFrame) -> DataFrame:
    """Company only filled; email and website replaced when the post states them."""
    post, headline = F.col("post_text"), F.col("author_headline")
    return leads.withColumns(
        {
            "company": F.coalesce(
                F.nullif(F.col("company"), F.lit("")), contact.company_name(post, headline)
            ),
            "contact_email": F.coalesce(contact.first_email(post), F.col("contact_email")),
            "website": F.coalesce(contact.first_website(post), F.col("website")),
        }
    )


def category_tally(spark: SparkSession, leads: DataFrame) -> DataFrame:
    """Rows per category, in reporting order and with zeros, and whether it is kept."""
    counts = leads.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    listed = spark.createDataFrame(list(enumerate(CATEGORIES)), "pos INT, category STRING")
    return listed.join(counts, "category", "left").select(
        "pos", "category", F.coalesce("n", F.lit(0)).alias("n"), classify.is_client(F.col("category")).alias("kept")
    )


def enrichment_tally(leads: DataFrame) -> DataFrame:
    """Rows seen and rows that carry each enriched fact."""

    def filled(name: str) -> Column:
        return F.count_if(F.coalesce(F.col(name), F.lit("")) != "")

    return leads.agg(
        F.count(F.lit(1)).alias("total"),
        filled("company").alias("with_company"),
        filled("contact_email").alias("with_email"),
        filled("website").alias("with_website"),
    )
