"""Near-duplicates, repeated strings, boilerplate lines and components against plain versions."""

import random
from pathlib import Path

import brute
import numpy as np
import pytest
import recall

from needwell.llm import graph, lines, near_dedup, repeats
from needwell.llm.hashing import prefix_sums, run_hashes

SF_DIR = "/root/testdata/sf0.1"


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("hot", [64, 5])
@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, result, monkeypatch, hot, width):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(near_dedup, "SETS_AT_ONCE", 3)
    expected = brute.near_duplicates(pairs(rows), width)
    want = [
        (i, len(brute.shingles(t, width)), expected[i][1] if i is not None else None, i is None or expected[i][1] == i)
        for i, t in pairs(rows)
    ]
    got = result(near_dedup.near_duplicates(docs, width), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(want, key=repr)


def fits(x, y):
    return y["n"] <= x["reach"] and x["n"] <= y["reach"]


def test_members_apart_are_all_pairs_that_fit(spark, result):
    rng = random.Random(4)
    data = []
    for t in range(12):
        for node in rng.sample(range(300), 40):
            n = rng.randrange(1, 60) if t % 2 else rng.randrange(95, 125)
            data.append({"node": node, "n": n, "t": t, "reach": int(2.25 * rng.randrange(n * 4 // 5, n + 1)) - n, "label": node % 5 if t % 3 else 3})
    held = spark.createDataFrame(data, "node long, n long, t long, reach long, label long")
    want = {
        (x["node"], y["node"]) for x in data for y in data if x["t"] == y["t"] and x["node"] < y["node"] and x["label"] != y["label"] and fits(x, y)
    }
    assert result(near_dedup._apart(held).distinct(), "a", "b") == sorted(want, key=repr) and len(want) > 500
    partners = result(near_dedup._with_partners(held), "node", "t")
    assert {(x["node"], x["t"]) for x in data for y in data if x is not y and x["t"] == y["t"] and fits(x, y)} <= set(partners)


def test_form_letters_below_the_similarity_are_not_compared(spark, monkeypatch):
    """Letters with 83 in 100 words of one form are no links; those with 95 are one group. No pair of the first is formed."""
    rng = random.Random(6)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    loose, tight = own(166), own(190)
    letters = [(i, f"{loose} {own(34 + i % 3)}") for i in range(200)] + [(500 + i, f"{tight} {own(10)}") for i in range(100)]
    formed, partners, apart = [], near_dedup._with_partners, near_dedup._apart
    monkeypatch.setattr(near_dedup, "_with_partners", lambda rows: formed.append(partners(rows).select("node").distinct().count()) or partners(rows))
    monkeypatch.setattr(near_dedup, "_apart", lambda rows: formed.append(apart(rows).count()) or apart(rows))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(letters, "doc_id long, text string"), 4).collect()}
    assert got == {i: i if i < 500 else 500 for i, _ in letters}
    assert formed == [100, 0]


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
def test_no_link_of_a_table_is_lost(spark):
    total, lost = recall.lost(spark.read.parquet(f"{SF_DIR}/documents.parquet"), 5)
    assert total > 10 and lost == 0


def test_keep_first_leaves_one_of_each_group(docs, rows, result):
    expected = brute.near_duplicates(pairs(rows), 5)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = result(kept, "doc_id")
    assert ids == sorted([(i,) for i, (_, c) in expected.items() if i == c] + [(None,)] * 3, key=repr)


def test_keep_first_whatever_the_columns_and_the_tasks(spark):
    """An inner name as a column, and two texts of one id: the same row stays, however rows are dealt."""
    texts = [(1, "a b c d e f", "x"), (1, "g h i j k l m", "y"), (2, "a b c d e f", None), (None, "n o", "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, _kept string")
    got = {tuple(sorted(map(tuple, near_dedup.keep_first(x).collect()), key=repr)) for x in (df, df.repartition(3), df.orderBy("_kept").coalesce(1))}
    assert len(got) == 1
    (rows,) = got
    assert len([r for r in rows if r[0] == 1]) == 1 and texts[3] in rows


def test_nothing_in_nothing_out(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_first(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert lines.strip_boilerplate(empty).count() == 0


@pytest.mark.parametrize("hot", [100, 2])
@pytest.mark.parametrize("big", [50_000, 3])
def test_repeats(docs, rows, result, monkeypatch, big, hot):
    monkeypatch.setattr(repeats, "BIG", big)
    monkeypatch.setattr(repeats, "HOT_DOCS", hot)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37" if big == 3 else "2000")
    got = result(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert got == sorted(brute.repeats(pairs(rows)), key=repr)
    assert sum(r[2] for r in got) > 5000


def test_partial_repeats_in_one_group(spark, result):
    """Windows shared with different documents, left and right of one passage."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh") for _ in range(400))
    cuts = [(i, base[rng.randrange(200) :][: rng.randrange(40, 200)]) for i in range(60)]
    noisy = [(i, "".join(rng.choice("xyz") for _ in range(9)) + t + "é" * (i % 4)) for i, t in cuts]
    df = spark.createDataFrame(noisy, "doc_id long, text string").repartition(3)
    got = result(repeats.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeats(noisy), key=repr)


def test_many_contexts_of_one_anchor_stay_apart(spark):
    """24 bits of a context's hash would call a dozen of these texts repeats."""
    rng = np.random.default_rng(11)
    grams = rng.integers(97, 123, (200_000, repeats.GRAM), np.uint8)
    bounds = np.arange(0, grams.size + 1, repeats.GRAM)
    anchor = grams[run_hashes(prefix_sums(grams.reshape(-1)), bounds[:-1], bounds[1:]).argmin()]
    sides = rng.integers(97, 123, (20_000, 2, repeats.SIDE), np.uint8)
    data = [(i, (left.tobytes() + anchor.tobytes() + right.tobytes()).decode()) for i, (left, right) in enumerate(sides)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert repeats.remove_repeats(df).where("n_removed > 0").count() == 0


def test_lines(docs, rows, result):
    want = [(i, n, r, brute.sha(k)) for i, n, r, k in brute.lines([(r[0], r[3], r[1]) for r in rows], 4)]
    from pyspark.sql import functions as F

    slim = docs.select("doc_id", "source", "text")
    cut = lines.without_boilerplate(slim, 4).select(
        "doc_id",
        F.greatest(F.size("_lines"), F.lit(0)).alias("n"),
        F.greatest(F.size("_lines") - F.size("_kept"), F.lit(0)).alias("r"),
        F.sha2(F.coalesce(F.array_join("_kept", "\n"), F.lit("")), 256).alias("k"),
    )
    got = result(cut, "doc_id", "n", "r", "k")
    assert got == sorted(want, key=repr)
    assert sum(r[2] for r in got) > 5


def test_strip_keeps_columns_and_counts_characters(docs, rows):
    stripped = lines.strip_boilerplate(docs, 4)
    assert stripped.columns == docs.columns and stripped.schema == docs.schema
    assert stripped.count() == len(rows)
    assert stripped.where("n_chars <> length(text)").count() == 0


def test_sketch_decides_far_lines_and_counts_near_ones(spark, result):
    data = [(s * 100 + i, f"s{s}", f"line {n}") for n in range(1, 40) for s in range(n) for i in range(2)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    assert lines.boilerplate(df, 20).count() == 20
    assert lines.boilerplate(df, 8).count() == 32


def test_components(spark, result):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(300, 340)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = result(graph.components(spark.createDataFrame(edges, "a long, b long")), "node", "label")
    assert found == sorted([(n, root(n)) for n in parent if n != 5], key=repr)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
