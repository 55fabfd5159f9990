"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Texts are lower-cased (A-Z) and cut into words. One automaton holds every run of words of a block of
items; the words of a document stream through it, and at each word its state and match length tell
the longest run ending there that occurs in some item. A length of WINDOW or more means a hit, and
so does the whole of a shorter item. Hits of a document are merged into spans; a document is contaminated
if spans cover at least a twentieth of its words. `cut_contaminated` takes out of the texts the spans that
are too long, or all spans where they cover too much; `drop_contaminated` leaves out the documents instead, and
`decontaminate` does both: documents where spans cover too much go, and the others lose the spans that are too long.

The benchmark is a query set, read in blocks of its distinct items: a block has about BLOCK_BYTES of text, is
shipped to the workers as one broadcast of that size, and is one narrow pass over the documents. No shuffle of
documents at all. Several blocks chain; after every fourth the rows go to the shared folder and the blocks
are let go, so that no task runs more than four automata and the driver holds no more blocks.

Defined cases: a null or wordless text has no hits and is clean; a null or wordless item has no
window; an item without id counts as one item named `null`, repeated ids count once; repeated
documents are judged each; empty tables give no rows, or no hits. Spans are cut from the start of their first word to
the end of their last one, as found in the text as given: what remains is not scanned again, and a text that is
nothing but spans keeps the signs around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query, table
from .staging import staged

WINDOW = 13
COVERAGE = 20
BLOCK_BYTES = 1 << 20

_IS_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else (b if b in _IS_WORD else 0x20) for b in range(256))

_SPACED = bytes(b if b in _IS_WORD or 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_ADDED = "_dc_n_words long, _dc_spans array<struct<start:long,end:long>>, _dc_items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words of a text in UTF-8."""
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """All runs of words of some items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(name, [self.number.setdefault(w, len(self.number)) for w in words]) for name, words in items if words]
        for _, run in coded:
            last = 0
            for word in run:
                last = self._extend(last, word)
        #: items of a state that holds a whole window, and short items that end in a state or in a suffix of it
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, run in coded:
            state = 0
            for i, word in enumerate(run):
                state = self.next[state][word]
                if i >= window - 1:
                    state = self.trimmed(state)
                    self.full.setdefault(state, set()).add(name)
            if len(run) < window:
                self.short.setdefault(state, []).append((len(run), name))
        if self.short:
            for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                above = self.short.get(self.link[state])
                if above:
                    self.short[state] = self.short.get(state, []) + above

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._state(self.length[last] + 1, {}, -1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            there = self.next[last][word]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        return new

    def _state(self, length: int, out: dict[int, int], link: int) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, last: int, word: int, there: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[there]), self.link[there])
        while last >= 0 and self.next[last].get(word) == there:
            self.next[last][word] = copy
            last = self.link[last]
        self.link[there] = copy
        return copy

    def trimmed(self, state: int) -> int:
        """The state of the last `window` words of what a state holds."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans of hit words, end exclusive, and the names of the items hit."""
        spans: list[list[int]] = []
        names: set[str] = set()
        number, step, link, length = self.number.get, self.next, self.link, self.length
        state = size = 0
        for i, word in enumerate(map(number, words)):
            if word is None:
                state = size = 0
                continue
            there = step[state].get(word)
            if there is None:
                while state and there is None:
                    state = link[state]
                    there = step[state].get(word)
                if there is None:
                    size = 0
                    continue
                size = length[state]
            state = there
            size += 1
            found = 0
            if size >= self.window:
                found = size
                names |= self.full[self.trimmed(state)]
            if self.short:
                for n, name in self.short.get(state, ()):
                    if n <= size:
                        found = max(found, n)
                        names.add(name)
            if found:
                start = i + 1 - found
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = i + 1
                    spans[-1][0] = min(start, spans[-1][0])
                    while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                        spans[-2] = [min(spans[-2][0], spans[-1][0]), i + 1]
                        spans.pop()
                else:
                    spans.append([start, i + 1])
        return spans, names


_built: dict[str, Automaton] = {}


def _automaton(name: str, block) -> Automaton:
    """The worker's automaton of a block; a worker keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(*block.value)
    return _built[name]


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, list[bytes]]]]]:
    """How many blocks the distinct items make, and the blocks, each read when it is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("binary").alias("text"))
    items = items.where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1

    def read() -> Iterator[list[tuple[str, list[bytes]]]]:
        for number in range(count):
            rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == number).toLocalIterator()
            yield [(r["name"], words_of(bytes(r["text"]))) for r in rows]

    return count, read()


def scan(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns kept, with _dc_n_words, _dc_spans (merged, of words) and _dc_items of each row."""
    spark = docs.sparkSession
    count, blocks = _blocks(benchmark, block_bytes)
    out = docs.select(*dict.fromkeys([*keep, "text"]))
    held = []
    for number, items in enumerate(blocks):
        held.append(spark.sparkContext.broadcast((items, window)))
        out = _pass(out, held[-1], keep, number == 0, number == count - 1)
        if number % 4 == 3 and number < count - 1:
            out = staged(out, "contamination")
            for block in held:
                block.unpersist()
            held = []
    return out


def _pass(docs: DataFrame, block, keep: list[str], first: bool, last: bool) -> DataFrame:
    added = T._parse_datatype_string(_ADDED)
    own = [c for c in docs.columns if c not in added.names and (not last or c in keep)]
    schema = T.StructType([docs.schema[c] for c in own] + added.fields)
    name = f"{block._jbroadcast.id()}-{docs.sparkSession.sparkContext.applicationId}"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(name, block)
        for batch in batches:
            counts, spans, items = [], [], []
            before = None if first else (batch.column("_dc_spans").to_pylist(), batch.column("_dc_items").to_pylist())
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                words = words_of(text.as_py())
                found, names = machine.hits(words)
                if before:
                    found = _merge(found + [[s["start"], s["end"]] for s in before[0][i]])
                    names |= set(before[1][i])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in found])
                items.append(sorted(names))
            columns = [batch.column(c) for c in own] + [pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, own + added.names)

    return docs.mapInArrow(run, schema)


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def _hit_words():
    return F.aggregate("_dc_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def _contaminated():
    return (F.size("_dc_spans") > 0) & (COVERAGE * _hit_words() >= F.col("_dc_n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans, contaminated of every row."""
    return scan(docs, benchmark, ["doc_id"], **options).select(
        "doc_id",
        F.col("_dc_n_words").alias("n_words"),
        _hit_words().alias("n_hit"),
        F.col("_dc_items").alias("items"),
        F.col("_dc_spans").alias("spans"),
        _contaminated().alias("contaminated"),
    )


def _scanned(docs: DataFrame, benchmark: DataFrame, **options) -> tuple[DataFrame, list[str]]:
    """All columns of documents under names that cannot meet those of the scan, but for the text; and these names."""
    names = ["text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)]
    return scan(docs.toDF(*names), benchmark, names, **options), names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of documents that are not contaminated, with their columns as they are."""
    found, names = _scanned(docs, benchmark, **options)
    return found.where(~_contaminated()).select(*names).toDF(*docs.columns)


_RUN = re.compile(rb"[^ ]+")


def without_spans(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """A text in UTF-8 without the words of some spans; spans are in order and apart."""
    places = [m.span() for m in _RUN.finditer(text.translate(_SPACED))]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*kept, text[at:]])


@F.arrow_udf(T.StringType())
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans; null texts, which have nothing to cut, stay null."""
    texts = (t.as_py() for t in text.cast(pa.binary()))
    cut = [None if t is None else without_spans(t, s) for t, s in zip(texts, spans.to_pylist(), strict=True)]
    return pa.array(cut, pa.binary()).cast(pa.string())


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, coverage: int = COVERAGE, **options) -> DataFrame:
    """All rows of documents, their texts without spans of `length` words or more, and without any
    span where together they are one in `coverage` words or more. Only texts that change leave the JVM.
    """
    out = F.when(coverage * _hit_words() >= F.col("_dc_n_words"), F.col("_dc_spans")).otherwise(_long_spans(length))
    found, names = _scanned(docs, benchmark, **options)
    return _without(found.withColumn("_dc_out", out), names).toDF(*docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, **options) -> DataFrame:
    """The rows of documents that are not contaminated, without spans of `length` words or more; n_chars, where
    there is one, follows a text that changes, and all else stays as it is.
    """
    found, names = _scanned(docs, benchmark, **options)
    left = _without(found.where(~_contaminated()).withColumn("_dc_out", _long_spans(length)), [*names, "_dc_out"])
    counted = [c for c, own in zip(names, docs.columns, strict=True) if own == "n_chars"]
    cells = [
        F.when(F.size("_dc_out") > 0, F.length("text").cast(left.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in counted else F.col(c)
        for c in names
    ]
    return left.select(*cells).toDF(*docs.columns)


def _long_spans(length: int) -> Column:
    return F.filter("_dc_spans", lambda s: s["end"] - s["start"] >= length)


def _without(found: DataFrame, names: list[str]) -> DataFrame:
    """Some columns of rows, the text without the spans in _dc_out."""
    text = F.coalesce(_cut(F.when(F.size("_dc_out") > 0, F.col("text")), F.col("_dc_out")), "text")
    return found.select(*[text.alias(c) if c == "text" else F.col(c) for c in names])


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM items),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, n, i, item_id FROM windows JOIN items USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op9_decontamination", SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
