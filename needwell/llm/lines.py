"""Removal of boilerplate lines that spread over many sites, all in column functions.

The spread of a line is the number of distinct sources it occurs in. Lines and sources are hashed once, into a
table of numbers; it shrinks to a row for each line and source, and lines that
never leave one source are set aside by the smallest and largest source hash. For the rest, HyperLogLog sketches of the sources merge per line hash.
Lines whose estimate is near the threshold get an exact distinct count; the others are decided by the
sketch. A line on MIN_SITES sources or more is boilerplate: it goes from every document but the one
with the smallest id, so nothing is lost altogether, and one whole copy of a copied document stays.

Hot lines cost a row per task, as all aggregations combine before they shuffle. Only hashes move, until
each document is joined with its own list of lines to drop.

Defined cases: lines are compared without surrounding blanks; blank lines are no boilerplate and stay;
a null text has no lines; a null source is a site of its own; rows without id lose a boilerplate line
unless no row with an id has it; repeated rows lose the same lines; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .staging import staged

MIN_SITES = 8
SKETCH_BITS = 10
#: estimates this close to the threshold are counted exactly: five standard errors of a sketch
NEAR = 5 * 1.04 / 2 ** (SKETCH_BITS / 2)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame) -> DataFrame:
    """A row of fixed width for each distinct line that is not blank, of each document; split and hashed once."""
    hashes = F.array_distinct(
        F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _hash)
    )
    rows = docs.where("text IS NOT NULL").select(
        "doc_id",
        F.xxhash64(F.coalesce("source", F.lit(""))).alias("site"),
        _row_key().alias("row"),
        F.explode(hashes).alias("line"),
    )
    return staged(rows, "lines")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line (hash), first (smallest id that has it) of every boilerplate line."""
    return _boilerplate(_lines(docs), min_sites)


def _boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Of rows of lines: one row for each line and site first, then what the sites of a line say."""
    sites = lines.groupBy("line", "site").agg(F.min("doc_id").alias("first"))
    ends = sites.groupBy("line").agg(F.min("site").alias("low"), F.max("site").alias("high"))
    # the lines that occur in more than one site, written down: few, and sketched in a stage of their own
    travelled = staged(sites.join(ends.where("low != high").select("line"), "line", "left_semi"), "travelled")
    sketches = travelled.groupBy("line").agg(
        F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.min("first").alias("first")
    )
    spread = staged(sketches.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    band = max(1.0, NEAR * min_sites)
    near = spread.where(F.abs(F.col("sites") - min_sites) <= band)
    exact = (
        travelled.join(near.select("line"), "line", "left_semi")
        .groupBy("line")
        .agg(F.count("*").alias("sites"), F.min("first").alias("first"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where(F.col("sites") > min_sites + band).select("line", "first").unionByName(exact.select("line", "first"))


def _dropped(docs: DataFrame, min_sites: int) -> DataFrame:
    """row, drop: the line hashes that each row loses."""
    lines = _lines(docs)
    spread = _boilerplate(lines, min_sites)
    lost = lines.join(spread, "line").where(
        F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first")))
    )
    return lost.groupBy(F.col("row").alias("_row")).agg(F.collect_set("line").alias("_drop"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns, with `_lines` and `_kept`: the lines of the text, and those that stay."""
    lines = F.split("text", "\n")
    keep = F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_drop", _hash(x)))
    joined = docs.withColumn("_key", _row_key()).join(_dropped(docs, min_sites), F.col("_key") == F.col("_row"), "left")
    split = joined.withColumn("_lines", lines)
    return split.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(keep)).drop("_key", "_row", "_drop")


def strip_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All rows with boilerplate lines cut from the text; n_chars, where there is one, follows the text."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_doc"))
    cut = without_boilerplate(rows, min_sites).withColumn("_text", F.array_join("_kept", "\n"))
    cells = {name: F.col(f"_doc.{name}") for name in docs.columns}
    cells["text"] = F.col("_text")
    if "n_chars" in cells:
        length = F.length("_text").cast(docs.schema["n_chars"].dataType)
        cells["n_chars"] = F.when(F.size("_kept") < F.size("_lines"), length).otherwise(cells["n_chars"])
    return cut.select(*[cell.alias(name) for name, cell in cells.items()])


SQL = """
WITH l AS (
  SELECT doc_id, i, line, trim(line, ' ') AS norm, coalesce(source, '') AS site
  FROM (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
spread AS (
  SELECT norm, min(doc_id) AS first FROM l WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 8),
kept AS (
  SELECT l.doc_id, i, line, spread.norm IS NULL OR l.doc_id = spread.first AS stays
  FROM l LEFT JOIN spread ON l.norm = spread.norm),
docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS kept
  FROM kept GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN docs ON documents.doc_id = docs.doc_id
"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that many sources share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = without_boilerplate(docs)
    kept = F.coalesce(F.array_join("_kept", "\n"), F.lit(""))
    return cut.select(
        "doc_id",
        F.greatest(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.length(kept).cast("long").alias("n_chars_kept"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
