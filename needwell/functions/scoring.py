"""Freshness, need match and the blended lead score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needwell.config import ScoringConfig
from needwell.functions import lexicon as lx
from needwell.functions.classify import all_signals_lowered, has_request_lowered, is_client, lowered, occurs, signals_any
from needwell.functions.text import content_tokens, strip

SECONDS_PER_DAY = 86_400.0
HALF_LIFE_FLOOR = 1e-6


def _percent(value: Column) -> Column:
    """Rounded half to even and clamped to 0..100."""
    return F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(100.0)).cast("int")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def freshness_details(
    posted_at: Column, first_seen: Column, now: Column, cfg: ScoringConfig = ScoringConfig()
) -> Column:
    """STRUCT(score, used_fallback, age_days) of the exponential decay."""
    reference = F.coalesce(posted_at, first_seen)
    age = F.greatest(F.lit(0.0), (_seconds(now) - _seconds(reference)) / F.lit(SECONDS_PER_DAY))
    age = F.when(reference.isNull(), F.lit(0.0)).otherwise(age)
    half_life = max(cfg.freshness_half_life_days, HALF_LIFE_FLOOR)
    decayed = F.lit(100.0) * F.pow(F.lit(0.5), age / F.lit(half_life))
    penalised = F.when(posted_at.isNull(), decayed * F.lit(cfg.freshness_fallback_penalty)).otherwise(decayed)
    score = F.when(reference.isNull(), F.lit(0)).otherwise(_percent(penalised))
    return F.struct(
        score.alias("score"), posted_at.isNull().alias("used_fallback"), age.alias("age_days")
    )


def freshness(
    posted_at: Column, first_seen: Column, now: Column, cfg: ScoringConfig = ScoringConfig()
) -> Column:
    """Freshness score 0..100."""
    return freshness_details(posted_at, first_seen, now, cfg)["score"]


def solicited(text: Column) -> Column:
    """The text says that its author is shopping for something."""
    return signals_any(text, lx.SOLICITATION)


def need_phrase(need: Column) -> Column:
    """The need as it is searched: trimmed and lower-cased."""
    return F.lower(strip(F.coalesce(need, F.lit(""))))


def tokens_present(low: Column, tokens: Column) -> Column:
    """The tokens that occur as whole words in lower-cased text."""
    # the plain substring test spares nearly every row the boundary regex
    return F.filter(
        tokens,
        lambda t: F.contains(low, t) & F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b"))),
    )


def need_match_struct(
    low: Column, phrase: Column, tokens: Column, present: Column, cfg: ScoringConfig = ScoringConfig()
) -> Column:
    """STRUCT(score, full_phrase, matched_tokens, total_tokens, solicited) from prepared parts."""
    total = F.size(tokens)
    usable = (total > 0) & (low != "")
    full = usable & F.contains(low, phrase)
    matched = F.when(usable, F.size(present)).otherwise(F.lit(0))
    base = (
        F.when(full, F.lit(cfg.need_full_phrase))
        .when(matched == total, F.lit(cfg.need_all_tokens))
        .when(matched > 0, F.lit(cfg.need_partial_cap) * (matched / total))
        .otherwise(F.lit(cfg.need_topic_floor))
    )
    asks = usable & (matched > 0) & occurs(low, lx.SOLICITATION)
    bonus = F.when(
        asks,
        F.when(base >= cfg.need_all_tokens, F.lit(cfg.need_solicitation_bonus)).otherwise(
            F.lit(cfg.need_solicitation_bonus / 2)
        ),
    ).otherwise(F.lit(0.0))
    return F.struct(
        F.when(usable, _percent(base + bonus)).otherwise(F.lit(0)).alias("score"),
        full.alias("full_phrase"),
        matched.alias("matched_tokens"),
        total.alias("total_tokens"),
        asks.alias("solicited"),
    )


def with_need_match(
    df: DataFrame,
    low: str,
    need: str,
    out: str,
    cfg: ScoringConfig = ScoringConfig(),
) -> DataFrame:
    """Adds the need-match struct ``out`` from a lower-cased text column.

    Tokens and their hits are columns of their own, so each is computed once per row.
    """
    return (
        df.withColumn("_phrase", need_phrase(F.col(need)))
        .withColumn("_tokens", content_tokens(F.col("_phrase")))
        .withColumn("_present", tokens_present(F.col(low), F.col("_tokens")))
        .withColumn(
            out,
            need_match_struct(F.col(low), F.col("_phrase"), F.col("_tokens"), F.col("_present"), cfg),
        )
        .drop("_phrase", "_tokens", "_present")
    )


def clamp_quality(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def lead_score(
    category: Column,
    freshness_score: Column,
    need_score: Column,
    quality_score: Column,
    cfg: ScoringConfig = ScoringConfig(),
) -> Column:
    """Weighted blend of the rounded factors, capped for everything but client leads."""
    share = cfg.shares()
    blended = (
        F.lit(share["freshness"]) * freshness_score
        + F.lit(share["need_match"]) * need_score
        + F.lit(share["data_quality"]) * clamp_quality(quality_score)
    )
    capped = F.when(is_client(category), blended).otherwise(
        F.least(blended, F.lit(float(cfg.non_client_score_cap)))
    )
    return _percent(capped)


def score_breakdown(
    category: Column,
    text: Column,
    author_name: Column,
    freshness_struct: Column,
    need_score: Column,
    quality_score: Column,
    cfg: ScoringConfig = ScoringConfig(),
) -> Column:
    """STRUCT that explains a score: factors, weights, fallback, cap and signals."""
    return score_breakdown_lowered(
        category, lowered(text), lowered(author_name), freshness_struct, need_score, quality_score, cfg
    )


def score_breakdown_lowered(
    category: Column,
    low: Column,
    low_author: Column,
    freshness_struct: Column,
    need_score: Column,
    quality_score: Column,
    cfg: ScoringConfig = ScoringConfig(),
) -> Column:
    """:func:`score_breakdown` over columns that are lower-cased already."""
    return F.struct(
        category.alias("category"),
        freshness_struct["score"].alias("freshness"),
        need_score.alias("need_match"),
        clamp_quality(quality_score).alias("data_quality"),
        F.struct(*[F.lit(share).alias(factor) for factor, share in cfg.shares().items()]).alias("weights"),
        freshness_struct["used_fallback"].alias("freshness_used_fallback"),
        (~is_client(category)).alias("non_client_capped"),
        has_request_lowered(low).alias("has_request"),
        all_signals_lowered(low, low_author).alias("signals"),
    )
