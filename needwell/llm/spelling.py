"""Spelling variants: words that differ by one code point, and the common form that a rare one goes back to.

Two words are near if the one becomes the other by one inserted, deleted or replaced code point. Near
words are what a one-edit transducer T accepts between the vocabulary's acceptor A and itself: A o T o A.
Before the edit both sides read the same, so both stand in the same state of A; after it they have to
read the same rest. The edit of an accepted pair stands at the end of the common prefix, at one place.

The composition is enumerated by parts. A part takes the edits at places lo to hi of pairs whose shorter
word has m code points: both words then share what stands before lo and what follows hi, and that is the
part's key. Each word goes to the parts it can have a near word in (halves of two lengths at first), each
part is one initial state: the minimal acceptor of what its words have in between is built there and
composed with T. Parts with more than PART words are halved again, down to one place, where all words of a part
are near each other. So no task meets more than a bounded part, and no pair is looked at without a
common prefix and a common rest.

Counting, keys and grouping are Spark's; Python builds acceptors of parts, streaming over sorted keys.

Defined cases: null and empty texts have no words; a row without id still has words, and none loses a
code point; repeated rows count twice; among near words of one count the first in code-point order is
the form; an empty table gives no rows.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .staging import staged

SHORTEST = 7
OFTEN = 2
RATIO = 10
PART = 4096
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, spoiled: int | None = None) -> DataFrame:
    """word, n: lower-cased runs of letters, of at least `shortest` code points and `often` occurrences.

    With `spoiled`, a run loses a code point wherever that number divides the hash of id and run.
    """
    # a run that may lose a code point still has to have enough of them
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{shortest},}})"), 1)).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    found = found.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)))
    word = F.col("run")
    if spoiled:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % spoiled == 0, less).otherwise(word)
    counted = found.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= often)


def _key(m: Column, lo: Column, hi: Column) -> Column:
    """The part of a word: length of the shorter word, places of the edit, what stands before and after them."""
    before = F.substring("word", F.lit(1), lo)
    after = F.when(hi <= m, F.substring("word", F.length("word") - (m - hi) + 1, m - hi)).otherwise("")
    return F.concat_ws(" ", m, lo, hi, F.concat(before, F.lit("|"), after))


def _parts(words: DataFrame) -> DataFrame:
    """key, word, n: every word in the halves of both lengths that a pair with it can have."""
    sizes = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    return _keyed(sizes.withColumn("place", F.explode(halves)))


def _keyed(places: DataFrame) -> DataFrame:
    return places.select(_key(F.col("m"), F.col("place.lo"), F.col("place.hi")).alias("key"), "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """The same words in parts of half as many places."""
    place = [F.split_part("key", F.lit(" "), F.lit(i)).cast("int") for i in (1, 2, 3)]
    cut = rows.select("word", "n", *[c.alias(a) for c, a in zip(place, ("m", "lo", "hi"), strict=True)])
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return _keyed(cut.withColumn("place", F.explode(both)))


def parts(words: DataFrame, most: int = PART) -> DataFrame:
    """key, word, n of all parts; those with more than `most` words are halved while they have two places."""
    rows, done = _parts(words), None
    while True:
        narrow = F.split_part("key", F.lit(" "), F.lit(3)).cast("int") - F.split_part("key", F.lit(" "), F.lit(2)).cast("int")
        large = rows.groupBy("key").agg(F.count("*").alias("_size")).where((F.col("_size") > most) & (narrow > 1))
        large = staged(large.select("key"), "large-parts")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = staged(_halved(rows.join(large, "key", "left_semi")), "halved-parts")


class Acceptor:
    """The minimal acceptor of some strings, built in sorted order; state 0 ends with nothing to follow."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        last = ""
        for s in strings:
            shared = 0
            for a, b in zip(last, s, strict=False):
                if a != b:
                    break
                shared += 1
            self._close(path, last, shared)
            for _ in s[shared:]:
                path.append(({}, [False]))
            path[-1][1][0] = True
            last = s
        self._close(path, last, 0)
        self.start = self._state(*path[0])
        self._alive: dict[tuple[int, int], bool] = {}

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        signature = (final[0], *arcs.items())
        state = self._known.get(signature)
        if state is None:
            state = self._known[signature] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return state

    def _close(self, path: list, last: str, depth: int) -> None:
        """Replace what hangs below a depth by states that are already known, where there are any."""
        while len(path) - 1 > depth:
            state = self._state(*path.pop())
            path[-1][0][last[len(path) - 1]] = state

    def alive(self, p: int, q: int) -> bool:
        """Whether both states accept something in common."""
        if p == q:
            return True
        stack = [(p, q) if p < q else (q, p)]
        top, known = stack[0], self._alive
        while stack:
            pair = stack[-1]
            if pair not in known:
                p, q = pair
                found: bool | None = self.final[p] and self.final[q]
                if not found:
                    other = self.arcs[q]
                    for sign, to in self.arcs[p].items():
                        too = other.get(sign)
                        if too is None:
                            continue
                        below = (to, too) if to < too else (too, to)
                        if to == too or known.get(below):
                            found = True
                            break
                        if below not in known:
                            stack.append(below)
                            found = None
                            break
                if found is None:
                    continue
                known[pair] = found
            stack.pop()
        return known[top]

    def common(self, p: int, q: int) -> Iterator[str]:
        """What both states accept."""
        stack, read = [(p, q, 0, "")] if self.alive(p, q) else [], []
        while stack:
            p, q, depth, sign = stack.pop()
            if depth:
                read[depth - 1 :] = sign
            if self.final[p] and self.final[q]:
                yield "".join(read)
            other = self.arcs[q]
            for sign, to in self.arcs[p].items():
                too = other.get(sign)
                if too is not None and self.alive(to, too):
                    stack.append((to, too, depth + 1, sign))

    def near(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs of A o T o A, the shorter string first."""
        stack, read = [(self.start, 0, "")], []
        while stack:
            state, depth, sign = stack.pop()
            if depth:
                read[depth - 1 :] = sign
            so_far = None
            arcs = list(self.arcs[state].items())
            for i, (a, s) in enumerate(arcs):
                for b, t in [(None, state), *arcs[i + 1 :]]:
                    if self.alive(s, t):
                        so_far = "".join(read) if so_far is None else so_far
                        for rest in self.common(s, t):
                            if b is not None:
                                yield so_far + a + rest, so_far + b + rest
                            elif rest[:1] != a:
                                # a is inserted; a rest that begins with it has its edit further on
                                yield so_far + rest, so_far + a + rest
            stack += [(to, depth + 1, a) for a, to in arcs]


def _shared(strings: list[str]) -> int:
    """Length of the common prefix of sorted strings."""
    return len(os.path.commonprefix([strings[0], strings[-1]]))


def _pairs_of(key: str, words: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
    """Near words of a part, each pair in both directions."""
    m, lo, hi, around = key.split(" ")
    before, after = around.split("|")
    size, first, end = int(m), len(before), len(after)
    middles = sorted(w[first : len(w) - end] for w in words)
    # what all of them share needs no states
    first = _shared(middles)
    middles = [x[first:] for x in middles]
    end = min(_shared(sorted(x[::-1] for x in middles)), min(map(len, middles)))
    before, after = before + min(words)[len(before) :][:first], middles[0][len(middles[0]) - end :] + after
    for one, other in Acceptor(sorted(x[: len(x) - end] for x in middles)).near():
        u, v = before + one + after, before + other + after
        # an inserted code point may belong to a later part, where what follows begins with it too
        if len(u) == size and (len(v) == size or len(os.path.commonprefix([u, v])) < int(hi)):
            yield u, words[u], v, words[v]
            yield v, words[v], u, words[u]


def near_words(words: DataFrame, most: int = PART) -> DataFrame:
    """word, n, near, near_n: every two near words, in both directions."""
    schema = "word string, n long, near string, near_n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, {}, []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)],
                ["word", "n", "near", "near_n"],
            )
            out.clear()
            return batch

        for batch in batches:
            for own, word, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if own != key:
                    if len(group) > 1:
                        for pair in _pairs_of(key, group):
                            out.append(pair)
                            if len(out) >= 20_000:
                                yield flush()
                    key, group = own, {}
                group[word] = n
        if len(group) > 1:
            for pair in _pairs_of(key, group):
                out.append(pair)
                if len(out) >= 20_000:
                    yield flush()
        if out:
            yield flush()

    return parts(words, most).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last one, by doubling; a chain gets RATIO times as frequent at each step."""
    links = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        longer = links.join(on, F.col("root") == F.col("_word"), "left")
        links = staged(
            longer.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "forms"
        )
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, most: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n)."""
    words = staged(words.select("word", "n"), "vocabulary")
    best = near_words(words, most).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    usual = -F.col("best.less")
    chosen = usual >= ratio * F.col("n")
    found = staged(
        best.select(
            "word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, usual).alias("form_n")
        ),
        "near-words",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return (
        words.join(found, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
        )
    )


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (
  SELECT run, count(*) AS c, any_value(hex(encode(CAST(doc_id AS VARCHAR) || ':' || run))) AS x
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
summed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h FROM hashed),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (
  SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT s.word, s.n, l.word, l.n FROM words s JOIN less l ON s.word = l.head || l.tail
  UNION SELECT l.word, l.n, s.word, s.n FROM words s JOIN less l ON s.word = l.head || l.tail),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n),
forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 10 * n),
walk AS (
  SELECT word, form AS top FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.top),
roots AS (SELECT word, top AS root FROM walk WHERE top NOT IN (SELECT word FROM forms))
SELECT words.word, form, coalesce(root, words.word) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one in 31 misspelt, with their near words, forms and roots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(vocabulary(docs, spoiled=31))
