"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Every row has a global row number in 0..n-1 that depends on the data alone: rows are ordered by a
hash of their key, cut into a fixed number of hash buckets, ranked inside a bucket, and a prefix
sum over the bucket counts (a table of BUCKETS rows, whatever the input) makes the rank global.
No row number depends on how Spark has placed the rows, so a task that runs again gives the same.

The permutation maps the row number to a position; `shard = position % shards` and
`slot = position // shards`. Any (shard, slot) can be computed from a row number, and back, without
the table (`locate`, `row_at`). Counts of shards are at most one apart.

Defined cases: a null text has no bytes; null ids are ordered first; rows that agree in id and text
take neighbouring row numbers in either order; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table

BUCKETS = 8192
ROUNDS = 6
SEED = 20240229

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _half_bits(n: int) -> int:
    """Bits of each half of the smallest even-width domain that holds n numbers."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = half + np.uint64(key % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
    return (x ^ (x >> np.uint64(31))) & np.uint64(2**bits - 1)


def _keys(seed: int) -> list[int]:
    return [(seed + 1) * 0x9E3779B97F4A7C15 * (r + 1) for r in range(ROUNDS)]


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    left, right = x >> np.uint64(bits), x & np.uint64(2**bits - 1)
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _round(left, key, bits), left
        else:
            left, right = right, left ^ _round(right, key, bits)
    return (left << np.uint64(bits)) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Positions of row numbers in a permutation of 0..n-1; with back, row numbers of positions.

    Numbers that leave 0..n-1 walk on along their cycle until they are inside again: the domain
    is less than four times n, so a walk takes under four steps on average, and it always ends.
    """
    bits, keys = _half_bits(n), _keys(seed)
    out = _once(rows.astype(np.uint64), bits, keys, back)
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = _once(out[outside], bits, keys, back)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    position = int(permute(np.array([row]), n, seed)[0])
    return position % shards, position // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number that a shard holds at a slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(rows: DataFrame, key: list[str], row: str = "row_no", total: str = "n_rows") -> DataFrame:
    """Add a global row number and the number of rows; only data decides, never partitions.

    The bucket counts are a table of at most BUCKETS rows: its prefix sum is one small task and
    its broadcast has that bound. Rows themselves move once.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*key)).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)))
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias(total),
    )
    within = Window.partitionBy("_bucket").orderBy("_h", *key)
    return (
        hashed.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(row, F.col("_start") + F.col("_rank"))
        .drop("_h", "_bucket", "_start", "_rank")
    )


def assign_shards(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard, slot of every row."""

    @F.pandas_udf("long")
    def position(row: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), int(n.iloc[0]), seed) if len(row) else [], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered = number_rows(slim, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("_position", position("row_no", "n_rows"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_no",
        (F.col("_position") % shards).cast("int").alias("shard"),
        F.floor(F.col("_position") / shards).cast("long").alias("slot"),
    )


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the law `rows`."""
    placed = assign_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
