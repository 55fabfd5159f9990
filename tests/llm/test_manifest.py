"""The Merkle manifest against a plain version: trees as lists of lists."""

from zlib import crc32

import brute
import pytest
from pyspark.sql import functions as F

from needwell.llm import manifest


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text) -> str:
    return brute.sha("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def climb(nodes: list[str], fan: int):
    """Root of a list of hashes, and for each the (before, after) hashes on its way up."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run = nodes[p // fan * fan :][:fan]
            paths[i].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
        nodes = [brute.sha("".join(nodes[j : j + fan])) for j in range(0, len(nodes), fan)]
        places = [p // fan for p in places]
    return nodes[0] if nodes else None, paths


def plain(rows, fan: int):
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = (own, *climb([leaf(r, r["text"]) for r in own], fan))
    root, tops = climb([trees[s][1] for s in sources], fan)
    for s, top in zip(sources, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + top
            tried = r["text"]
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0 and tried is not None:
                tried = brute.lower(tried)
            folded = leaf(r, tried)
            for before, after in path:
                folded = brute.sha(before + folded + after)
            proof = brute.sha("".join(b + a for b, a in path))
            yield r["doc_id"], leaf(r, r["text"]), subroot, root, proof, folded, folded == root


def sealed(docs):
    rows = manifest.manifest(docs, manifest.lower_cased())
    rows = rows.withColumn("folded", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.withColumn("proof", manifest.proof(F.col("path"))).withColumn("verified", F.col("folded") == F.col("root"))


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof", "folded", "verified")


@pytest.fixture
def fan(monkeypatch, request):
    monkeypatch.setattr(manifest, "FAN", request.param)
    monkeypatch.setattr(manifest, "BLOCK", request.param**2)
    return request.param


@pytest.mark.parametrize("fan", [2, 16], indirect=True)
def test_equals_plain_trees(docs, result, fan):
    """With a fan of 2 the trees have many tiers, and one source has a third of all rows."""
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("s1")).otherwise(F.col("source")))
    got = result(sealed(hot), *COLUMNS)
    want = sorted(plain([r.asDict() for r in hot.collect()], fan), key=repr)
    assert got == want
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 600])
def test_sizes_at_which_trees_grow(spark, result, n):
    rows = [(i, f"Text {i}", None, "only", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(sealed(docs), *COLUMNS) == sorted(plain([r.asDict() for r in docs.collect()], 16), key=repr)


def test_nulls_everywhere_and_repeated_rows(spark, result):
    rows = [(None, None, None, None, None)] * 3 + [(7, "", "", "", 0)] * 20 + [(-7, "É\0x", "a", "é", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(sealed(docs), *COLUMNS) == sorted(plain([r.asDict() for r in docs.collect()], 16), key=repr)


def test_empty_table(empty):
    assert sealed(empty).count() == 0


def test_a_changed_field_is_found(docs):
    row = docs.where("doc_id = 30").first()
    good = manifest.manifest(docs, F.lit(None).cast("string")).where("doc_id = 30")
    assert good.where(manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == docs.where("doc_id = 30").count()
    forged = brute.sha(leaf(row, row["text"] + " "))
    assert good.where(manifest.folded(F.lit(forged), F.col("path")) == F.col("root")).isEmpty()
