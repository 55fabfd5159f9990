"""Links of near-duplicates found again: documents with an id divisible by 50 against all rows, by their words.

`python tests/llm/recall.py /root/testdata/check_s 4` prints the figures for a folder of tables and a shingle width.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import brute
from pyspark.sql import DataFrame

from needwell.llm.near_dedup import SIMILARITY, near_duplicates


def links(docs: list[tuple[int, str | None]], width: int) -> list[tuple[int, int]]:
    """Pairs (query, document) whose sets of word shingles, compared as texts, reach the similarity."""
    queries = [(i, brute.shingles(t, width)) for i, t in docs if i % 50 == 0]
    holders = defaultdict(list)
    for number, (_, own) in enumerate(queries):
        for shingle in own:
            holders[shingle].append(number)
    found = []
    for doc_id, text in docs:
        own = brute.shingles(text, width)
        common = Counter(number for shingle in own if shingle in holders for number in holders[shingle])
        for number, shared in common.items():
            query, other = queries[number]
            if query != doc_id and 100 * shared >= SIMILARITY * (len(own) + len(other) - shared):
                found.append((query, doc_id))
    return found


def lost(docs: DataFrame, width: int) -> tuple[int, int]:
    """How many links there are, and how many have their ends in different components."""
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    exact = links([tuple(r) for r in known.collect()], width)
    component = {r["doc_id"]: r["component_id"] for r in near_duplicates(known, width).select("doc_id", "component_id").collect()}
    return len(exact), sum(component[a] != component[b] for a, b in exact)


if __name__ == "__main__":
    import tempfile

    from needwell.session import build_session

    folder = tempfile.mkdtemp(prefix="recall-")
    spark = build_session("recall", "local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": folder})
    total, gone = lost(spark.read.parquet(f"{sys.argv[1]}/documents.parquet"), int(sys.argv[2]))
    print(f"links {total}, lost {gone}")
    spark.stop()
