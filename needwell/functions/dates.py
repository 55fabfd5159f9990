"""Timestamps and recency windows; the clock is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from needwell.functions.text import strip

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:[Zz]|[+\-]\d{2}:?\d{2})?)?$"
)

# Days per unit and the bucket limits.
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
BUCKET_LIMITS = (("d", 1), ("w", 7), ("m", 31))
OLDEST_BUCKET = "y"


def parse_iso(value: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, no offset meaning UTC; NULL when unreadable."""
    text = strip(value)
    has_offset = text.rlike(r"(?:[Zz]|[T ][^+\-]*[+\-]\d{2}:?\d{2})$")
    with_seconds = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(?=$|[Zz+\-])", "$1:00")
    dotted = F.replace(with_seconds, F.lit(","), F.lit("."))
    return F.when(
        text.rlike(_ISO),
        F.try_to_timestamp(
            F.when(has_offset, dotted)
            .when(F.char_length(dotted) == 10, F.concat(dotted, F.lit("T00:00:00Z")))
            .otherwise(F.concat(dotted, F.lit("Z")))
        ),
    )


def recency_days(window: Column) -> Column:
    """Days of a window such as ``7d`` or ``1Y``; NULL when unknown."""
    pattern = r"(?i)^\s*(\d+)\s*([dwmy])\s*$"
    amount = F.regexp_extract(window, pattern, 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(window, pattern, 2))
    days = None
    for name, factor in UNIT_DAYS.items():
        days = (F.when if days is None else days.when)(unit == name, amount * factor)
    return days


def recency_bucket(window: Column) -> Column:
    """Smallest of day, week, month, year that covers a window; NULL when unknown."""
    days = recency_days(window)
    bucket = None
    for name, limit in BUCKET_LIMITS:
        bucket = (F.when if bucket is None else bucket.when)(days <= limit, name)
    return bucket.when(days.isNotNull(), OLDEST_BUCKET)


def clock(now: datetime | str) -> Column:
    """A TIMESTAMP literal for the run's clock; a naive value is UTC."""
    text = now if isinstance(now, str) else now.isoformat(sep=" ")
    return F.when(F.lit(True), parse_iso(F.lit(text)))


def utc_day_start(ts: Column) -> Column:
    """Start of the UTC day (the session zone is UTC)."""
    return F.date_trunc("DAY", ts)


def age_cutoff(now: Column, days: int | Column) -> Column:
    """``now`` minus a number of days."""
    span = F.lit(days) if isinstance(days, int) else days
    return now - F.make_dt_interval(span)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text with a numeric offset, micro-seconds only where present."""
    fraction = F.when(
        F.pmod(F.unix_micros(ts), F.lit(1_000_000)) != 0, F.date_format(ts, ".SSSSSS")
    ).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
