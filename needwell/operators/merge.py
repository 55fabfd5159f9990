"""Keyed, null-preserving upsert.

"Last non-NULL value wins" is an associative reduction, so a batch is first
reduced per key with map-side combine (a hot key costs one row per task) and
then joined to the stored table, where both sides are unique by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needwell import schemas
from needwell.operators.ingest import ARRIVAL_COLUMNS

KEY = "post_url"
PROVENANCE = ("id", "first_seen", "last_updated")
# never NULL in an arrival, so the latest row supplies all of them at once
ALWAYS_SET = (
    "author_name",
    "need_text",
    "post_text",
    "platform",
    "data_quality_score",
    "quality_flags",
)


def lead_id(post_url: Column) -> Column:
    """Stable id of a lead."""
    return F.sha2(post_url, 256)


def reduce_arrivals(valid: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per ``post_url``: the last non-NULL value of every column.

    Adds ``arrivals`` (rows seen) and ``first_need`` (need of the first arrival).
    Columns an upload does not carry stay absent.
    """
    present = [c for c in valid.columns if c not in (KEY, seq, *PROVENANCE)]
    together = [c for c in present if c in ALWAYS_SET]
    alone = [c for c in present if c not in ALWAYS_SET]
    order = F.col(seq)
    reduced = valid.groupBy(KEY).agg(
        F.max_by(F.struct(*together), order).alias("_set"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in alone],
        F.min_by("need_category", order).alias("first_need"),
        F.count(F.lit(1)).alias("arrivals"),
    )
    return reduced.select(
        KEY, *[F.col(f"_set.{c}").alias(c) for c in together], *alone, "first_need", "arrivals"
    )


def merge_arrivals(stored: DataFrame, reduced: DataFrame, now: Column) -> DataFrame:
    """Stored leads after the batch, plus ``was_new``, ``arrivals`` and ``first_need``.

    ``id`` and ``first_seen`` never change; ``last_updated`` moves only when some
    column changed. One full-outer equi-join on the key.
    """
    types = {f.name: f.dataType for f in schemas.INTENT_LEADS}
    values = [c for c in types if c not in (KEY, *PROVENANCE)]
    old = stored.select(KEY, F.struct(*[c for c in types if c != KEY]).alias("old"))
    incoming = [c for c in values if c in reduced.columns]
    new = reduced.select(KEY, F.struct(*incoming, "arrivals", "first_need").alias("new"))
    joined = old.join(new, KEY, "full_outer")

    def default(name: str) -> Column:
        if name in schemas.LEAD_LIST_DEFAULTS:
            return F.array().cast(types[name])
        return F.lit(schemas.LEAD_DEFAULTS.get(name)).cast(types[name])

    merged = {}
    changed = F.lit(False)
    for name in values:
        before = F.col(f"old.{name}")
        after = F.coalesce(F.col(f"new.{name}"), before) if name in incoming else before
        merged[name] = F.coalesce(after, default(name)) if name != "lead_score" else after
        changed = changed | ~after.eqNullSafe(before)
    was_new = F.col("old").isNull()
    out = {
        **merged,
        "id": F.coalesce("old.id", lead_id(F.col(KEY))),
        "first_seen": F.coalesce("old.first_seen", now),
        "last_updated": F.when(was_new | changed, now).otherwise(F.col("old.last_updated")),
        KEY: F.col(KEY),
    }
    return joined.select(
        *[out[f.name].cast(f.dataType).alias(f.name) for f in schemas.INTENT_LEADS],
        was_new.alias("was_new"),
        F.coalesce("new.arrivals", F.lit(0)).alias("arrivals"),
        F.col("new.first_need").alias("first_need"),
    )


def upsert(stored: DataFrame, valid: DataFrame, now: Column, seq: str = "seq") -> DataFrame:
    """The stored table after applying a batch of valid rows in ``seq`` order."""
    merged = merge_arrivals(stored, reduce_arrivals(valid, seq), now)
    return merged.drop("was_new", "arrivals", "first_need")


def upsert_tally(merged: DataFrame) -> DataFrame:
    """Distinct new leads and later arrivals counted as updates."""
    new = F.count_if(F.col("was_new"))
    return merged.agg(
        new.alias("stored_new"), (F.coalesce(F.sum("arrivals"), F.lit(0)) - new).alias("stored_updated")
    )


def need_tally(valid: DataFrame, merged: DataFrame) -> DataFrame:
    """New and updated per need: a new lead counts for the need that saw it first."""
    arrivals = valid.groupBy(F.col("need_category").alias("need")).agg(F.count(F.lit(1)).alias("n"))
    firsts = (
        merged.where("was_new")
        .groupBy(F.col("first_need").alias("need"))
        .agg(F.count(F.lit(1)).alias("stored_new"))
    )
    both = arrivals.join(firsts, "need", "left")
    new = F.coalesce("stored_new", F.lit(0))
    return both.select("need", new.alias("stored_new"), (F.col("n") - new).alias("stored_updated"))


def backfill(snapshot: DataFrame) -> DataFrame:
    """An older snapshot projected onto the current schema with defaults filled in."""
    have = set(snapshot.columns)
    out = []
    for f in schemas.INTENT_LEADS:
        value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in schemas.LEAD_LIST_DEFAULTS:
            value = F.coalesce(value, F.array().cast(f.dataType))
        elif f.name in schemas.LEAD_DEFAULTS:
            value = F.coalesce(value, F.lit(schemas.LEAD_DEFAULTS[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return snapshot.select(*out)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended by name; columns the new rows lack become NULL."""
    return df.unionByName(rows, allowMissingColumns=True)


__all__ = [
    "ARRIVAL_COLUMNS", "backfill", "delete_keys", "insert_rows", "lead_id", "merge_arrivals",
    "need_tally", "reduce_arrivals", "upsert", "upsert_tally",
]
