"""Ranked exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needwell.config import CLIENT_LEAD
from needwell.functions.dates import iso_text
from needwell.operators import rank

FORMATS = ("csv", "json")


def export_view(ranked: DataFrame) -> DataFrame:
    """Export columns with time stamps as ISO text, missing ones as empty cells."""
    posted = F.coalesce(iso_text(F.col("posted_at")), F.lit("")).alias("posted_at")
    return ranked.select(*[posted if c == "posted_at" else F.col(c) for c in rank.EXPORT_COLUMNS])


def export_leads(
    leads: DataFrame,
    path: str,
    fmt: str = "csv",
    category: str = CLIENT_LEAD,
    cutoff: Column | None = None,
    limit: int | None = None,
) -> None:
    """Write the ranking in order.

    Part files follow the ranking, so their names in order give the whole list;
    only a limited export is gathered into a single file.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r} (use {' or '.join(FORMATS)})")
    view = export_view(rank.ranked(leads, category, cutoff, limit))
    writer = (view if limit is None else view.coalesce(1)).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    else:
        writer.json(path)


def export_explained(
    explained: DataFrame, path: str, category: str = CLIENT_LEAD, cutoff: Column | None = None
) -> None:
    """Ranked JSON records with the score breakdown of each lead."""
    ranked = rank.ranked(explained, category, cutoff)
    posted = iso_text(F.col("posted_at")).alias("posted_at")
    record = [posted if c == "posted_at" else F.col(c) for c in (*rank.EXPORT_COLUMNS, "breakdown")]
    ranked.select(*record).write.mode("overwrite").json(path)
