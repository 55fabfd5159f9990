"""Removal of long byte strings that repeat an earlier document, on a sparse enhanced suffix array.

Every window of LENGTH bytes holds an anchor: the GRAM-byte string with the smallest hash in it. Equal
windows hold equal anchors, so suffixes need to start at anchors only, some six in a hundred bytes.

1. What a window can reach around an anchor (LENGTH - GRAM bytes to both sides) is its context. Rows hold
   GROUP_BITS of the anchor's hash, then all 64 bits of the context's: the first of these share a column with
   the group, so one column settles most of the order. Distinct (anchor, context, document) rows are
   dealt by anchor and sorted. A row after another document with the same
   context is a whole repeat. Of the rest, anchors with one context only are dropped; a group of anchors
   cut by the border of a batch stays in any case. Anchors that more than BIG documents have, going by
   a sample, are spread over partitions of their own, where all that is no whole repeat stays.
2. Each document gets back its context hashes of both kinds. The contexts of the kind that is left are cut out of
   its text and sorted by anchor and right context: a suffix array, with the common-prefix lengths of
   neighbours beside it. The intervals of its common-prefix tree are visited by depth; inside one, the
   common lengths of the reversed left contexts tell where left extensions differ, and so which
   occurrences share a whole window. All occurrences count, not just neighbours. Depth is bounded, so
   the visit is a loop over LENGTH - GRAM + 1 levels for all intervals at once.
   A group with over BIG rows, or of a spread anchor, is not held together: what its rows in
   hand leave open among themselves becomes rows of windows, which are aggregated.
3. An occurrence is removed where a window of it is in a document with a smaller id. The reach of an
   anchor is one interval, for every window of it holds the anchor.

Strings are compared by 64-bit hashes of themselves or of parts of them.

Defined cases: a null text is empty; texts under LENGTH bytes are left whole; a row without id is left
whole and is no earlier document; rows of one id do not remove from each other, and a repeated row gets
the same result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import U64, chunks, mix, prefix_sums, run_hashes
from .registry import query, table
from .staging import staged

LENGTH = 50
GRAM = 16
SIDE = LENGTH - GRAM
WIDTH = 2 + 2 * SIDE
BIG = 50_000
GROUP_BITS = 40
#: frequent anchors have over BIG rows, going by HOT_DOCS documents or more in a sample of about HOT_SAMPLE
HOT_SAMPLE = 20_000
HOT_DOCS = 100
HOT_WAYS = 16


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every run of `width` numbers, in a logarithmic number of passes."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return best(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, text numbers and hashes of the anchors of some texts laid end to end, and the prefix sums of the bytes."""
    sums = prefix_sums(data)
    windows = SIDE + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), sums
    starts = np.arange(len(data) - GRAM + 1)
    hashes = run_hashes(sums, starts, starts + GRAM)
    least = _slide(hashes, windows, np.minimum)
    edge = np.zeros(windows - 1, U64)
    chosen = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), windows, np.maximum) == hashes)
    text = np.searchsorted(bounds, chosen, "right") - 1
    inside = (chosen + GRAM <= bounds[text + 1]) & (bounds[text + 1] - bounds[text] >= LENGTH)
    chosen, text = chosen[inside], text[inside]
    return chosen, text, hashes[chosen], sums


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(sums: np.ndarray, bounds: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of the anchors' contexts."""
    start = np.maximum(at - SIDE, bounds[text])
    end = np.minimum(at + LENGTH, bounds[text + 1])
    return mix(run_hashes(sums, start, end) + (at - start).astype(U64))


def _contexts(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Bytes after each anchor, then those before it in reverse; each side after its length."""
    right = _side(data, at + GRAM, 1, bounds[text + 1] - at - GRAM)
    left = _side(data, at - 1, -1, at - bounds[text])
    return np.concatenate([right, left], axis=1)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (key, rest, doc_id) of the anchors: bits of the anchor's hash and its context's hash, over two columns."""
    low = U64(64 - GROUP_BITS)
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for row, data, bounds in chunks(batch.column("text")):
            at, text, hashes, sums = anchors(data, bounds)
            keys = _keys(sums, bounds, at, text)
            order = np.lexsort((keys, text))
            text, keys, hashes = text[order], keys[order], hashes[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])
            text, keys, hashes = text[new], keys[new], hashes[new]
            yield pa.RecordBatch.from_arrays(
                [
                    _signed((hashes >> low << low) | (keys >> U64(GROUP_BITS))),
                    _signed(keys << low >> low),
                    pa.array(ids[row + text]),
                ],
                ["key", "rest", "doc_id"],
            )


def _sorted_out(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted batches that repeat an earlier document as a whole, or may in part."""
    spread = TaskContext.get().partitionId() >= parts
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rest, doc = (batch.column(c).to_numpy() for c in ("key", "rest", "doc_id"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])
        runs = np.flatnonzero(new)
        whole = doc > doc[runs][np.cumsum(new) - 1]
        group = key >> (64 - GROUP_BITS)
        border = np.ones(len(key), bool)
        border[1:] = group[1:] != group[:-1]
        number = np.cumsum(border) - 1
        several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(border)) > 1
        several[0] = several[-1] = True
        several |= spread
        keep = whole | several[number]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[keep]), pa.array(key[keep] << GROUP_BITS | rest[keep]), pa.array(whole[keep])],
            ["doc_id", "key", "whole"],
        )


def _side(data: np.ndarray, at: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
    """Up to SIDE bytes from `at` on in one direction, padded, after their number."""
    out = np.zeros((len(at), SIDE + 1), np.uint8)
    count = np.minimum(room, SIDE)
    out[:, 0] = count
    for j in range(SIDE):
        there = count > j
        out[there, 1 + j] = data[at[there] + step * j]
    return out


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of key lists; nulls are empty."""
    column = batch.column(name)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy().view(U64)


def _listed(keys: np.ndarray, first: np.ndarray, row: int, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which keys of texts are in the list of their row."""
    bounds, values = lists
    out = np.zeros(len(keys), bool)
    for i in range(len(first) - 1):
        own = values[bounds[row + i] : bounds[row + i + 1]]
        if len(own):
            out[first[i] : first[i + 1]] = np.isin(keys[first[i] : first[i + 1]], own)
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of texts that may repeat in part: h, context, doc_id, at, text hash."""
    for batch in batches:
        ids, lists = batch.column("doc_id").to_numpy(), _lists(batch, "parts")
        for row, data, bounds in chunks(batch.column("text")):
            at, text, hashes, sums = anchors(data, bounds)
            first = np.searchsorted(text, np.arange(len(bounds)))
            keep = _listed(_keys(sums, bounds, at, text), first, row, lists)
            at, text, hashes = at[keep], text[keep], hashes[keep]
            context = _contexts(data, bounds, at, text)
            fixed = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(WIDTH), len(context), [None, pa.py_buffer(np.ascontiguousarray(context))]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(hashes),
                    fixed.cast(pa.binary()),
                    pa.array(ids[row + text]),
                    pa.array((at - bounds[text]).astype(np.int64)),
                    _signed(run_hashes(sums, bounds[:-1], bounds[1:])[text]),
                ],
                ["h", "context", "doc_id", "at", "text_hash"],
            )


def _common(sides: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before it in an order; -1 where a group begins."""
    rows = sides[order]
    length = np.zeros(len(rows), np.int64)
    differ = rows[1:, 1:] != rows[:-1, 1:]
    length[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
    length[1:] = np.minimum(length[1:], np.minimum(rows[1:, 0], rows[:-1, 0]))
    length[0] = -1
    length[1:][group[order][1:] != group[order][:-1]] = -1
    return length


def _order(sides: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows by group, bytes, length: eight bytes make a number, so few columns are sorted."""
    padded = np.zeros((len(sides), -(-SIDE // 8) * 8), np.uint8)
    padded[:, :SIDE] = sides[:, 1:]
    numbers = padded.view(">u8")
    return np.lexsort([sides[:, 0], *(numbers[:, j] for j in range(numbers.shape[1] - 1, -1, -1)), group])


def reach(
    group: np.ndarray, context: np.ndarray, doc: np.ndarray
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each row, how far windows that a smaller document has too reach before and after the anchor's start.

    Rows of one group have the same anchor. Both are 0 where there is no such window. At last, for each
    number of bytes after the anchor, the rows of which no smaller document here has the window.
    """
    right, left = context[:, : SIDE + 1], context[:, SIDE + 1 :]
    back, ahead = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    by_right, by_left = _order(right, group), _order(left, group)
    common_right, common_left = _common(right, group, by_right), _common(left, group, by_left)
    right_id, left_id = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    first_rows = []
    for depth in range(SIDE + 1):
        # intervals of the common-prefix tree at this depth, and of the reversed left contexts at the rest
        right_id[by_right] = np.cumsum(common_right < depth)
        left_id[by_left] = np.cumsum(common_left < SIDE - depth)
        whole = np.flatnonzero((right[:, 0] >= depth) & (left[:, 0] >= SIDE - depth))
        first_rows.append(whole)
        if not len(whole):
            continue
        window = right_id[whole] * (len(group) + 1) + left_id[whole]
        _, inverse = np.unique(window, return_inverse=True)
        first = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, doc[whole])
        late = first[inverse] < doc[whole]
        hit, first_rows[-1] = whole[late], whole[~late]
        back[hit] = np.maximum(back[hit], SIDE - depth)
        ahead[hit] = np.maximum(ahead[hit], GRAM + depth)
    return back, ahead, first_rows


def window_hashes(
    h: np.ndarray, context: np.ndarray, rows: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, depth and hash of the windows of some rows, given by depth."""
    right, left = (np.ascontiguousarray(context[:, s : s + SIDE + 1]) for s in (0, SIDE + 1))
    sums = [prefix_sums(side.reshape(-1)) for side in (right, left)]
    depths, hashes = [], []
    for depth, own in enumerate(rows):
        at = own * (SIDE + 1) + 1
        parts = run_hashes(sums[0], at, at + depth) * U64(3) + run_hashes(sums[1], at, at + SIDE - depth) * U64(5)
        depths.append(np.full(len(own), depth))
        hashes.append(mix(h[own] + mix(parts + U64(depth))))
    return np.concatenate(rows), np.concatenate(depths), np.concatenate(hashes)


_REACH = "doc_id long, text_hash long, start long, end long, window long"


def _reaches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor to their reach, or to their windows where a group is not whole in hand."""
    spread = TaskContext.get().partitionId() >= parts
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    open_group = None  # a group grown too big
    for batch in batches:
        if not batch.num_rows:
            continue
        context = np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint8).reshape(-1, WIDTH)
        part = (batch.column("h").to_numpy(), context, *(batch.column(c).to_numpy() for c in ("doc_id", "at", "text_hash")))
        if spread:
            yield from _as_windows(part)
            continue
        if not size and open_group is not None:
            lead = int(np.searchsorted(part[0], open_group, "right"))
            if lead:
                yield from _as_windows(tuple(x[:lead] for x in part))
                part = tuple(x[lead:] for x in part)
            if not len(part[0]):
                continue
        cut = int(np.searchsorted(part[0], part[0][-1]))
        if cut or (size and held[-1][0][-1] != part[0][0]):
            yield _as_reach(_together([*held, tuple(x[:cut] for x in part)]))
            held, size, part = [], 0, tuple(x[cut:] for x in part)
        held.append(part)
        size += len(part[0])
        if size > BIG:
            yield from _as_windows(_together(held))
            open_group, held, size = held[0][0][0], [], 0
    if size:
        yield _as_reach(_together(held))


def _together(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _rows(doc, text_hash, start, end, window) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (doc, text_hash, start, end)] + [window], [c.split()[0] for c in _REACH.split(", ")]
    )


def _spans(part: tuple[np.ndarray, ...], back: np.ndarray, ahead: np.ndarray) -> pa.RecordBatch:
    _, _, doc, at, text_hash = part
    hit = ahead > 0
    start, end = (at - back)[hit], (at + ahead)[hit]
    return _rows(doc[hit], text_hash[hit], start, end, pa.nulls(len(start), pa.int64()))


def _as_reach(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    back, ahead, _ = reach(part[0], part[1], part[2])
    return _spans(part, back, ahead)


def _as_windows(part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """What the rows in hand settle among themselves, and the windows that other rows may still settle."""
    for low in range(0, len(part[0]), BIG):
        own = tuple(x[low : low + BIG] for x in part)
        back, ahead, firsts = reach(own[0], own[1], own[2])
        yield _spans(own, back, ahead)
        row, depth, window = window_hashes(own[0].view(U64), own[1], firsts)
        start = own[3][row] - (SIDE - depth)
        yield _rows(own[2][row], own[4][row], start, start + LENGTH, _signed(window))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")


class _Dealt:
    """How anchors go to partitions: by a hash, frequent ones spread over as many again."""

    def __init__(self, docs: DataFrame):
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = max(1, docs.count() // HOT_SAMPLE)
        sample = _texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        held = sample.mapInArrow(_holders, "key long, rest long, doc_id long")
        one = held.select(self._group("key").alias("anchor"), "doc_id").distinct()
        many = one.groupBy("anchor").agg(F.count("*").alias("docs")).where(F.col("docs") >= max(HOT_DOCS, BIG // every))
        # a document has a bounded share of its bytes as anchors, so few can be in so many documents
        self.frequent = [r["anchor"] for r in many.select("anchor").collect()]

    @staticmethod
    def _group(name: str) -> Column:
        return F.shiftrightunsigned(name, 64 - GROUP_BITS)

    def out(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows by the hash in a column, each group in one partition; frequent ones in HOT_WAYS, more where there are many parts."""
        group = self._group(name)
        # anchors are the smallest hashes around, so their ranges are uneven until they are hashed again
        even = F.pmod(F.xxhash64(group), F.lit(self.parts))
        ways = max(HOT_WAYS, self.parts // 8)
        spread = self.parts + F.pmod(F.xxhash64(group, F.pmod(F.xxhash64("doc_id"), F.lit(ways))), F.lit(self.parts))
        part = F.when(group.isin(self.frequent), spread).otherwise(even) if self.frequent else even
        return rows.repartitionById(2 * self.parts, part.cast("int"))


def _key_lists(docs: DataFrame, dealt: _Dealt) -> DataFrame:
    """doc_id, wholes, parts: the context hashes of a document's whole repeats, and of those that may be partial."""
    parts = dealt.parts
    holders = _texts(docs).mapInArrow(_holders, "key long, rest long, doc_id long")
    ordered = dealt.out(holders, "key").sortWithinPartitions("key", "rest", "doc_id")
    kinds = ordered.mapInArrow(lambda batches: _sorted_out(batches, parts), "doc_id long, key long, whole boolean")
    return kinds.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("whole"), F.col("key"))).alias("wholes"),
        F.collect_list(F.when(~F.col("whole"), F.col("key"))).alias("parts"),
    )


def _partial_spans(texts: DataFrame, lists: DataFrame, dealt: _Dealt) -> DataFrame:
    """doc_id, text_hash, start, end of partial repeats, overlapping ones included."""
    parts = dealt.parts
    rows = texts.join(lists, "doc_id").where(F.size("parts") > 0).mapInArrow(
        _partial, "h long, context binary, doc_id long, at long, text_hash long"
    )
    ordered = dealt.out(rows, "h").sortWithinPartitions("h")
    reaches = ordered.mapInArrow(lambda batches: _reaches(batches, parts), _REACH)
    windows = reaches.where("window IS NOT NULL")
    firsts = windows.groupBy("window").agg(F.min("doc_id").alias("first"))
    late = windows.join(firsts, "window").where("doc_id > first").select("doc_id", "text_hash", "start", "end")
    return reaches.where("window IS NULL").select("doc_id", "text_hash", "start", "end").unionByName(late)


def _whole_places(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
    """By row, where the anchors of whole repeats stand; rows without any are not looked at."""
    sizes = batch.column("wholes").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes)
    own = batch.take(pa.array(rows))
    lists, found = _lists(own, "wholes"), {}
    for row, data, bounds in chunks(own.column("text")):
        at, text, _, sums = anchors(data, bounds)
        first = np.searchsorted(text, np.arange(len(bounds)))
        whole = _listed(_keys(sums, bounds, at, text), first, row, lists)
        for i in range(len(bounds) - 1):
            here = slice(first[i], first[i + 1])
            found[int(rows[row + i])] = at[here][whole[here]] - bounds[i]
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, their keys of whole repeats and their other spans, to what is left and how much went."""
    for batch in batches:
        spans, places = batch.column("spans").to_pylist(), _whole_places(batch)
        out: list[tuple] = []
        for row, data, bounds in chunks(batch.column("text")):
            whole_texts = run_hashes(prefix_sums(data), bounds[:-1], bounds[1:]).view(np.int64)
            for i in range(len(bounds) - 1):
                size = int(bounds[i + 1] - bounds[i])
                own = [(max(p - SIDE, 0), min(p + LENGTH, size)) for p in places.get(row + i, np.zeros(0, int)).tolist()]
                own += [(s["start"], s["end"]) for s in spans[row + i] or () if s["text_hash"] == whole_texts[i]]
                merged: list[list[int]] = []
                for start, end in sorted(own):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                here, left, last = data[bounds[i] : bounds[i + 1]].tobytes(), [], 0
                for start, end in merged:
                    left.append(here[last:start])
                    last = end
                kept = b"".join([*left, here[last:]])
                out.append((size, size - len(kept), len(merged), hashlib.sha256(kept).hexdigest()))
        columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate([pa.int64()] * 3 + [pa.string()])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    The texts move once, by id; both readers of the key lists share that exchange.
    """
    texts, dealt = _texts(docs), _Dealt(docs)
    lists = staged(_key_lists(docs, dealt), "keys")
    spans = _partial_spans(texts, lists, dealt).distinct().groupBy("doc_id").agg(
        F.collect_list(F.struct("text_hash", "start", "end")).alias("spans")
    )
    known = texts.join(lists, "doc_id", "left").join(spans, "doc_id", "left").select("doc_id", "text", "wholes", "spans")
    other = docs.where("doc_id IS NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.lit(None).cast("array<bigint>").alias("wholes"),
        F.lit(None).cast("array<struct<text_hash:bigint,start:bigint,end:bigint>>").alias("spans"),
    )
    return known.unionByName(other).mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM late),
runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 49 AS e
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM runs),
cut AS (
  SELECT doc_id, sum(e - s + 1) AS gone, count(*) AS n, max(e) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (s - before - 1)), '' ORDER BY s) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query("op10_repeats", SQL)
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier one has."""
    return remove_repeats(table(spark, sf_dir, "documents"))
