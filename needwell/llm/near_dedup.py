"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is its set of distinct word shingles; its sketch holds the SKETCH smallest shingle
hashes. Equal sets are one node from the start. Inverted lists of retained values propose pairs, the
overlap of two sketches among the smallest values of their union estimates the similarity and drops
hopeless pairs, and the full sets, made again from the texts, confirm the rest exactly.

Two sets at similarity 0.8 have each of the smallest values of their union in common with
probability 0.8, so a few values per document suffice: with KEYS values, one pair in 1.5e11 has none.

A value kept by over HOT nodes (a common passage, or one large group of copies) makes a list too long
for all its pairs. Most holders of such a value have enough values that are not hot, and are compared
through those: linked documents share some. (Where a share of HOT_SHARE is hot in both, and all of
that is shared, the others are in common with probability 0.56; one pair in 5e5 then shares no key.)
Documents with more hot values are crowded, and are compared through their whole sets: only shingles
among the rarest that a link must share make lists, and what a document can share from a shingle on
bounds the size of those it can be linked with there: its reach. Two documents fit if each is within the
reach of the other. In each list all are first compared with the LEADERS that share most, and
components are built. Then only members outside a list's main component are compared with members of
other components, the smaller of two first: it has to reach its own size, which letters of one form
below the similarity don't, and it meets only sizes within its reach. So a large group of copies costs a few
comparisons per member, one of unlinked form letters none, and no pair of different components is left out.

Defined cases: a null or wordless text has no shingles and is linked with nothing; a text of fewer
words than a shingle is one shingle; rows with the same id count as one document; a row without id
takes part in nothing and is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .hashing import U64, chunks, mix, prefix_sums, run_hashes, words
from .registry import query, table
from .staging import staged

SKETCH = 48
KEYS = 16
HOT = 64
HOT_SHARE = 0.6
LEADERS = 2
#: an estimate this far below the threshold is over five standard deviations off
MARGIN = 0.35
SIMILARITY = 80
SHINGLE = 5
#: sizes are compared in steps of this ratio
STEP = 1.1
#: how much a Python worker holds at a time
PAIRS_AT_ONCE = 128
SETS_AT_ONCE = 64

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 32
_PLACES = mix(np.arange(1, 4097, dtype=U64)) | U64(1)


def _combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` word hashes."""
    total = np.zeros(len(hashes) - width + 1, U64)
    for j in range(width):
        total += hashes[j : len(hashes) - width + 1 + j] * _PLACES[j]
    return mix(total + U64(width))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, bounds in chunks(column):
        starts, ends, first = words(data, bounds, _IS_WORD)
        hashes = run_hashes(prefix_sums(data, _FOLD), starts, ends)
        for i in range(len(bounds) - 1):
            own = hashes[first[i] : first[i + 1]]
            yield np.unique(_combine(own, min(width, len(own)))) if len(own) else own


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, values = [], [], []
            for own in shingle_sets(batch.column("text"), width):
                counts.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                values.append((own[:SKETCH] >> U64(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sketch"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def _similar_size(a: str, b: str) -> Column:
    """Sets whose sizes are further apart can't reach the similarity."""
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _likely(a: str, b: str) -> Column:
    """Whether the union sketch of two documents leaves the similarity possible."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return shared >= F.size(union) * (SIMILARITY / 100 - MARGIN)


def _checked(pairs: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The pairs whose full sets reach the similarity; neighbours with the same first text share its set."""
    new = np.ones(pairs.num_rows, bool)
    new[1:] = np.diff(pairs.column("a").to_numpy()) != 0
    left = list(shingle_sets(pairs.column("text_a").filter(pa.array(new)), width))
    linked = []
    for i, y in zip(np.cumsum(new) - 1, shingle_sets(pairs.column("text_b"), width), strict=True):
        x = left[i]
        shared = len(np.intersect1d(x, y, assume_unique=True))
        linked.append(100 * shared >= SIMILARITY * (len(x) + len(y) - shared))
    return pairs.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets, made again from texts (node, text), reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                yield _checked(batch.slice(at, PAIRS_AT_ONCE), width)

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = texts.join(needed, "node", "left_semi")
    with_b = pairs.join(own.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    both = with_b.join(own.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch], most: int, width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and shingle sets of texts, some at a time."""
    for batch in batches:
        nodes, sets, at = batch.column("node").to_numpy(), shingle_sets(batch.column("text"), width), 0
        while part := list(islice(sets, most)):
            yield nodes[at : at + len(part)], part
            at += len(part)


def _prefixes(texts: DataFrame, width: int) -> DataFrame:
    """node, n, t, reach: the shingles through which a crowded document can meet another one.

    Shingles are counted over crowded documents. Those that no other one has can't be shared. In order
    of rarity, two sets of similarity 0.8 have one of the first n - ceil(0.8 n) + 1 shingles in
    common, so only these, less the ones nobody shares, make lists. The shared ones from t on are all
    that two documents can have in common if t is the first that they have: reach is the largest size
    of another document for which they are enough.

    Only counts up to HOT are told apart: rare shingles are joined with their count, and all others
    come after them by their own order. A hot shingle is counted in hand, and is a row per some
    hundreds of documents from then on.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, part in _sets(batches, SETS_AT_ONCE, width):
            values = pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), values], ["node", "all"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, part in _sets(batches, SETS_AT_ONCE * 16, width):
            owner = np.repeat(nodes, [len(x) for x in part])
            values, inverse, held = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
            owner = owner[np.argsort(inverse, kind="stable")]
            few = held <= HOT
            bounds = np.concatenate([[0], np.cumsum(np.where(few, held, 0))])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(owner[np.repeat(few, held)]))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(held), lists], ["t", "n", "nodes"])

    sets = staged(texts.mapInArrow(whole, "node long, all array<long>"), "sets")
    parts = staged(texts.mapInArrow(counted, "t long, n long, nodes array<long>"), "shingles")
    rare = parts.groupBy("t").agg(F.sum("n").alias("held")).where(F.col("held") <= HOT)
    owned = parts.join(rare, "t").select(F.explode("nodes").alias("node"), "held", "t")
    scarce = owned.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "t"))).alias("scarce"))
    none = F.array().cast("array<struct<held:bigint,t:bigint>>")
    known = sets.join(scarce, "node", "left").withColumn("scarce", F.coalesce("scarce", none))
    own = F.transform("scarce", lambda s: s["t"])
    split = known.select(
        "node",
        F.size("all").cast("long").alias("n"),
        F.transform(F.filter("scarce", lambda s: s["held"] > 1), lambda s: s["t"]).alias("rare"),
        F.array_sort(F.array_except("all", own)).alias("hot"),
    )
    ordered = split.select("node", "n", F.concat("rare", "hot").alias("shared"))
    c = F.size("shared").cast("long")
    most = F.greatest(c - F.ceil(F.col("n") * SIMILARITY / 100) + 1, F.lit(0)).cast("int")
    listed = ordered.select("node", "n", c.alias("shared"), F.posexplode(F.slice("shared", F.lit(1), most)).alias("place", "t"))
    rest = F.col("shared") - F.col("place")
    return listed.select("node", "n", "t", (F.floor(rest * (100 + SIMILARITY) / SIMILARITY) - F.col("n")).alias("reach"))


def _other(members: DataFrame) -> DataFrame:
    names = {"node": "other", "n": "m", "reach": "reach_m", "label": "other_label"}
    return members.withColumnsRenamed({k: v for k, v in names.items() if k in members.columns})


def _fit() -> Column:
    """Whether two crowded documents can share enough from a shingle on."""
    return (F.col("m") <= F.col("reach")) & (F.col("n") <= F.col("reach_m"))


def _with_partners(prefixes: DataFrame) -> DataFrame:
    """Members that may fit another one of their list: of two that fit, the smaller reaches its own size."""
    smaller = prefixes.where("reach >= n").groupBy("t").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    fitting = prefixes.join(smaller, "t").where("reach >= n OR (least <= reach AND n <= most)")
    return fitting.select("node", "n", "t", "reach")


def _apart(held: DataFrame) -> DataFrame:
    """Pairs (a, b) that fit, of members (node, n, t, reach, label) of one list with different labels.

    Members of a list's main label are not compared with each other. A smaller one stands at every step of
    size within its reach, a larger one at the step of its own; at each step only those within what the
    other side has are joined.
    """
    sizes = held.groupBy("t", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("t").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count("*").alias("parts"))
    split = held.join(main.where("parts > 1"), "t").withColumn("stray", F.col("label") != F.col("main")).drop("main", "parts")

    def step(size: str) -> Column:
        return F.floor(F.log(STEP, F.col(size)))

    small = split.where("reach >= n").withColumn("step", F.explode(F.sequence(step("n"), step("reach"))))
    large = _other(split.withColumnRenamed("stray", "other_stray")).withColumn("step", step("m"))
    both = ["t", "step"]

    def joined(small: DataFrame, large: DataFrame) -> DataFrame:
        ends = small.groupBy(both).agg(F.min("n").alias("least"), F.max("reach").alias("most"))
        large = large.join(ends, both).where("least <= reach_m AND m <= most").drop("least", "most")
        ends = large.groupBy(both).agg(F.min("m").alias("least"), F.max("reach_m").alias("most"))
        small = small.join(ends, both).where("least <= reach AND n <= most").drop("least", "most")
        ordered = F.struct("n", "node") < F.struct(F.col("m").alias("n"), F.col("other").alias("node"))
        return small.join(large, both).where(ordered & _fit() & (F.col("label") != F.col("other_label")))

    pairs = joined(small.where("stray"), large).unionByName(joined(small.where("NOT stray"), large.where("other_stray")))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = staged(sketches(docs, width), "sketches")
    real = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = staged(real.groupBy("set_key").agg(F.min("doc_id").alias("node")), "sets")
    nodes = real.join(sets.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    nodes = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch")

    values = nodes.select("node", F.explode("sketch").alias("v"))
    spread = staged(values.groupBy("v").agg(F.count("*").alias("held")).where("held > 1"), "spread")
    shared = values.join(spread, "v").groupBy("node").agg(
        F.array_sort(F.collect_list(F.when(F.col("held") <= HOT, F.col("v")))).alias("cool"),
        F.array_sort(F.collect_list(F.when(F.col("held") > HOT, F.col("v")))).alias("hot"),
    )
    profiles = staged(nodes.join(shared, "node"), "profiles")

    # lists of values that are not hot: all pairs, HOT / 2 per entry at most
    entries = profiles.select("node", "n", F.explode(F.slice("cool", 1, KEYS)).alias("v"))
    other = entries.withColumnsRenamed({"node": "other", "n": "m"})
    pairs = entries.join(other, "v").where((F.col("node") < F.col("other")) & _similar_size("n", "m"))
    pairs = pairs.select(F.col("node").alias("a"), F.col("other").alias("b"))
    sketch = lambda side: profiles.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"))

    def likely(proposed: DataFrame) -> DataFrame:
        both = proposed.distinct().join(sketch("a"), "a").join(sketch("b"), "b")
        return staged(both.where(_likely("sketch_a", "sketch_b")).select("a", "b"), "likely")

    cool = likely(pairs)

    # only documents that may have a link are read again: their texts move once. The ids grow with the
    # input, so they are merged with the texts at every size, and a small run shows what a large one moves
    crowded = profiles.where(F.size("hot") > F.least(F.col("n"), F.lit(SKETCH)) * HOT_SHARE).select("node")
    crowded = staged(crowded, "crowded")
    wanted = crowded.unionByName(cool.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = staged(named.join(wanted.hint("merge"), "node", "left_semi"), "texts")

    # documents made mostly of hot values, compared with each other: leaders first
    prefixes = staged(_prefixes(texts.join(crowded, "node", "left_semi"), width), "prefixes")
    members = staged(_with_partners(prefixes), "members")
    by_centre = Window.partitionBy("t").orderBy(F.desc(F.col("reach") / F.col("n")), "node")
    leaders = members.withColumn("_place", F.row_number().over(by_centre)).where(F.col("_place") <= LEADERS)
    stars = members.join(_other(leaders.drop("_place")), "t").where((F.col("node") != F.col("other")) & _fit())
    stars = stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    links = staged(_confirmed(cool.unionByName(likely(stars)).distinct(), texts, width), "links")
    labels = components(links)

    # what the leaders have left apart
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = likely(_apart(staged(named, "held")))
    more = staged(_confirmed(apart, texts, width), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    placed = sets.join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    joined = rows.join(placed, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_first(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One document of each group of near-duplicates, and every row without id; columns as they are.

    Of rows that share an id, the one with the smallest hash of all its values stays, whichever task finds it.
    """
    kept = near_duplicates(docs, width).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    hashed = [f.name for f in docs.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    named = docs.join(kept, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"), F.xxhash64(*hashed).alias("place"))
    one = named.groupBy("doc_id").agg(F.min_by("row", "place").alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


@query("op7_near_dedup", SQL)
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents, on shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
