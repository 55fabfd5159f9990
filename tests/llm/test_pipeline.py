"""The registered queries on the small tables, and the pipeline against plain versions of its stages."""

from pathlib import Path

import brute
import pytest
from compare import connect, difference

import __spark_entry__ as entry_module
import corpus_pipeline
from needwell.llm import bpe, quality, registry

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry_module.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in registry.QUERIES} and "pipeline" in names
    assert set(registry.QUERIES) <= names and set(registry.SQL) <= set(entry_module.oracle_sql())


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql_or_runs(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    if name in registry.SQL:
        assert difference(df, connect(SF_DIR), registry.SQL[name]) is None
    else:
        assert df.count() > 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_pipeline_over_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_plain_stages(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, rows[3][1]), (2, "a few words only that no document has in this order at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # the verdict of the quality rules is tested on its own; rows that agree in id and text share it
    verdicts = quality.quality(docs.select("doc_id", "text", "lang", "source"))
    good = {r["doc_id"] for r in verdicts.where("kept AND doc_id IS NOT NULL").collect()}
    kept = [(r[0], r[3], r[1]) for r in rows if r[0] in good]
    cut = [(i, text) for i, _, _, text in brute.lines(kept, 8)]
    groups = brute.near_duplicates(cut, 5)
    single = list({i: (i, t) for i, t in cut if groups[i][1] == i}.values())
    clean = {r[0] for r in brute.contamination(single, items) if not r[5]}
    own = bpe.encoder(bpe.default_vocabulary())
    want = [(i, len(ids), brute.sha(" ".join(map(str, ids)))) for i, t in single if i in clean for ids in [own.encode(t)]]

    got = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id IS NOT NULL").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == sorted(want)
    assert len(want) > 20
