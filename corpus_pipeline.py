"""A training corpus out of `documents`: five stages, each written as Parquet and read by the next.

Quality rules drop rejected documents, lines shared by many sources are cut, one document of each group of
near-duplicates stays, documents contaminated by the benchmark go, others lose its passages, and the rest is encoded and decoded.
The columns of `documents` stay as they are until the last stage, which returns digests of the ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from needwell.llm.bpe import round_trip
from needwell.llm.contamination import decontaminate
from needwell.llm.lines import strip_boilerplate
from needwell.llm.near_dedup import keep_first
from needwell.llm.quality import keep_good
from needwell.llm.registry import table
from needwell.llm.staging import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share."""
    return strip_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, on shingles of five words."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth, without these passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL has no byte-pair encoding; the tests hold the rows against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is in the shared folder before the next begins."""
    folder = f"{shared_folder(spark)}/needwell/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
