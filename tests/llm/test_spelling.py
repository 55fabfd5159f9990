"""Spelling variants against plain versions: all pairs of a small vocabulary."""

import random
import re
from collections import Counter
from zlib import crc32

import brute
import pytest

from needwell.llm import spelling


def words_of(docs, spoiled=31):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % spoiled == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(u: str, v: str) -> bool:
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(n: dict[str, int]):
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.fixture(scope="module")
def vocabulary():
    """Words full of doubled letters, shared halves and chains of forms."""
    rng = random.Random(3)
    n = {}
    for _ in range(300):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 9)))
        n[w] = rng.choice([2, 3, 25, 400, 6000])
    n |= {"colours": 2, "colour": 20, "colourss": 20, "colouurs": 200, "honourable": 2000, "honorable": 20, "honourablé": 200}
    n |= {"aaaaaaa" + "a" * k: 10**k + 2 for k in range(6)}
    return {w: c for w, c in n.items() if len(w) >= 7}


@pytest.mark.parametrize("most", [4096, 3])
def test_variants_equal_plain_pairs(spark, result, vocabulary, most):
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = result(spelling.variants(words, most=most), *COLUMNS)
    want = sorted(plain(vocabulary), key=repr)
    assert got == want
    assert any(r[2] != r[1] and r[1] is not None for r in got)


def test_pairs_come_once(spark, vocabulary):
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    for most in (4096, 3):
        pairs = [(r["word"], r["near"]) for r in spelling.near_words(words, most).collect()]
        assert len(pairs) == len(set(pairs)) == sum(near(u, v) for u in vocabulary for v in vocabulary)


def test_parts_are_halved(spark, vocabulary):
    """No part has more words than allowed, unless it has a single place."""
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    sizes = spelling.parts(words, 3).groupBy("key").count().collect()
    for r in sizes:
        _, lo, hi, _ = r["key"].split(" ")
        assert r["count"] <= 3 or int(hi) - int(lo) == 1


def test_acceptor_is_minimal_and_exact():
    rng = random.Random(1)
    for _ in range(200):
        strings = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 12))})
        machine = spelling.Acceptor(strings)
        languages = [frozenset(machine.common(i, i)) for i in range(len(machine.arcs))]
        assert len(set(languages)) == len(languages) and languages[machine.start] == set(strings)


def test_words_of_hostile_documents(docs, rows, result):
    more = docs.union(docs).union(docs)
    plain_words = words_of([(r[0], r[1]) for r in rows] * 3)
    assert result(spelling.vocabulary(more, spoiled=31), "word", "n") == sorted(plain_words.items(), key=repr)


def test_hostile_documents_whole(docs, rows, result):
    words = words_of([(r[0], r[1]) for r in rows])
    assert len(words) > 30
    assert result(spelling.variants(spelling.vocabulary(docs, spoiled=31)), *COLUMNS) == sorted(plain(words), key=repr)


def test_edges(spark, result):
    texts = ["ÀÉÿabcd ÀÉÿabcd", "AbcDefG-abcdefg", "×÷aaaaaaa÷aaaaaaa", None, "", "abcdef abcdef", "l" * 5000 + " " + "l" * 5000, "l" * 4999 + "x " + "ab" * 3000 + " " + "ab" * 2999 + "bb " + "ab" * 3000 + " " + "ab" * 2999 + "bb l" + "l" * 4998 + "x"]
    docs = spark.createDataFrame([(None, t, 1) for t in texts], "doc_id long, text string, word int")
    got = result(spelling.variants(spelling.vocabulary(docs)), *COLUMNS)
    assert got == sorted(plain(words_of([(None, t) for t in texts])), key=repr)


def test_empty_table(empty):
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
