"""Filters, rankings, counts and pages over stored leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from needwell.config import CLIENT_LEAD, resolve_category
from needwell.session import staged

#: a page that ends before this row is a bounded top-k; later ones are cut out by rank
TOP_ROWS = 10_000

# Columns of an exported ranking, in file order.
EXPORT_COLUMNS = (
    "author_name",
    "lead_score",
    "category",
    "need_text",
    "post_url",
    "posted_at",
    "platform",
)


def in_category(leads: DataFrame, value: str = CLIENT_LEAD) -> DataFrame:
    """Rows of one category; ``all`` keeps everything, unknown values raise."""
    wanted = resolve_category(value)
    return leads if wanted is None else leads.where(F.col("category") == wanted)


def newer_than(leads: DataFrame, cutoff: Column | None) -> DataFrame:
    """Rows posted (or first seen) at or after the cutoff; ``None`` keeps everything."""
    if cutoff is None:
        return leads
    return leads.where(F.coalesce("posted_at", "first_seen") >= cutoff)


def at_least_fresh(leads: DataFrame, minimum: int) -> DataFrame:
    """Rows whose freshness score reaches a minimum."""
    return leads.where(F.col("freshness_score") >= minimum)


def recent_order() -> list[Column]:
    return [F.col("first_seen").desc(), F.col("id").asc()]


def rank_order() -> list[Column]:
    return [F.col("lead_score").desc_nulls_last(), *recent_order()]


def most_recent(leads: DataFrame, limit: int | None = None) -> DataFrame:
    """Most recently captured first."""
    ordered = leads.orderBy(*recent_order())
    return ordered if limit is None else ordered.limit(limit)


def ranked(
    leads: DataFrame,
    category: str = CLIENT_LEAD,
    cutoff: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Best score first; unscored rows last. With a limit Spark plans a bounded top-k."""
    ordered = newer_than(in_category(leads, category), cutoff).orderBy(*rank_order())
    return ordered if limit is None else ordered.limit(limit)


def count_matching(
    leads: DataFrame, category: str = CLIENT_LEAD, cutoff: Column | None = None
) -> DataFrame:
    """Rows under the same filters as :func:`ranked`."""
    return newer_than(in_category(leads, category), cutoff).agg(F.count(F.lit(1)).alias("n"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, order: list[Column], first: int = 0, end: int | None = None) -> DataFrame:
    """Adds ``position``, the zero-based global rank under a total order; of ranks first to end, if given.

    Rows are dealt into ranges of the order, and the sizes of the ranges before its own (a table of one row
    per range) make a row's number inside a range global. Only ranges that
    overlap the wanted ranks are numbered, so no task holds the rows before a page.
    """
    ranges = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = starts.where(F.col("_start") + F.col("_n") > first)
    if end is not None:
        wanted = wanted.where(F.col("_start") < end)
    inside = W.partitionBy("_range").orderBy(*order)
    rows = ranges.join(wanted.select("_range", "_start"), "_range").withColumn("position", F.col("_start") + F.row_number().over(inside) - 1)
    rows = rows.where(F.col("position") >= first)
    if end is not None:
        rows = rows.where(F.col("position") < end)
    return rows.select(*df.columns, "position")


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page by offset under a total order; see :func:`page_after` for pages that follow each other."""
    if limit is not None and offset + limit <= TOP_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    if not offset and limit is None:
        return df.orderBy(*order)
    rows = numbered(df, order, offset, None if limit is None else offset + limit)
    return rows.orderBy("position").drop("position")


def page_after(leads: DataFrame, last: dict, limit: int) -> DataFrame:
    """The page that follows a ranked row (its score, first_seen and id).

    The position is a filter, so a deep page costs as much as the first one.
    """
    score, seen, ident = F.col("lead_score"), F.col("first_seen"), F.col("id")
    after_seen = (seen < F.lit(last["first_seen"])) | (
        (seen == F.lit(last["first_seen"])) & (ident > F.lit(last["id"]))
    )
    if last["lead_score"] is None:
        follows = score.isNull() & after_seen
    else:
        value = F.lit(last["lead_score"])
        follows = score.isNull() | (score < value) | ((score == value) & after_seen)
    return leads.where(follows).orderBy(*rank_order()).limit(limit)


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows with the given key values, e.g. ``post_url=...`` or ``source=..., query=...``."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df
