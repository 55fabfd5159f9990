"""Run accounting against a plain sequential replay of the rules."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from needwell.config import RunLimits
from needwell.functions.dates import clock
from needwell.operators import runs

SCHEMA = "run_id STRING, source STRING, query STRING, seq LONG, url STRING, outcome STRING, ts TIMESTAMP, rejected BOOLEAN"


def random_log(seed, n=600, n_runs=5):
    rng = random.Random(seed)
    start = datetime(2025, 1, 1)
    rows = []
    for seq in range(n):
        # one run holds about a third of everything
        run = "hot" if rng.random() < 0.35 else f"r{rng.randrange(n_runs)}"
        outcome = rng.choices(["ok", "blocked", "parse_error", "transient"], [3, 4, 2, 1])[0]
        rows.append((run, f"s{run}", f"q{run}", seq, f"u{rng.randrange(80)}", outcome, start + timedelta(minutes=seq), rng.random() < 0.3))
    return rows


def replay(rows, limits):
    """The rules one attempt at a time."""
    state = defaultdict(lambda: {"visited": 0, "found": 0, "rejects": 0, "errors": 0, "blocks": 0, "status": "completed", "message": None, "done": False})
    for run, _, _, _, _, outcome, _, rejected in sorted(rows, key=lambda r: r[3]):
        s = state[run]
        if s["done"]:
            continue
        if limits.extracted_limit is not None and s["found"] >= limits.extracted_limit:
            s["done"] = True
            continue
        if s["visited"] >= limits.daily_cap:
            s["done"], s["message"] = True, f"daily request cap reached ({limits.daily_cap})"
            continue
        s["visited"] += 1
        if outcome == "blocked":
            s["blocks"] += 1
            if s["blocks"] >= limits.block_limit:
                s.update(done=True, status="aborted", message=f"aborted after {limits.block_limit} consecutive blocks")
        elif outcome == "parse_error":
            s["rejects"] += 1
        elif outcome == "transient":
            s["errors"] += 1
        else:
            s["blocks"] = 0
            s["found"] += 1
            s["rejects"] += rejected
    return {
        run: (s["status"], s["visited"], s["found"], s["rejects"], s["errors"], s["message"])
        for run, s in state.items()
    }


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limits", [RunLimits(40, 6, 12), RunLimits(25, 9, None), RunLimits(500, 5, 300), RunLimits(12, 12, 4)])
def test_summaries_equal_sequential_replay(spark, seed, limits):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    got = runs.summarize_runs(runs.stop_runs(log, limits), limits).collect()
    assert {
        r.run_id: (r.status, r.pages_visited, r.leads_found, r.rejects, r.errors, r.error_message) for r in got
    } == replay(rows, limits)


@pytest.mark.parametrize("chunk_rows", [1, 2, 7, 50, 1000])
@pytest.mark.parametrize("limit", [1, 3, 5])
def test_abort_does_not_depend_on_ranges(spark, chunk_rows, limit):
    rows = random_log(11, n=400)
    expected, blocks = {}, defaultdict(int)
    for run, _, _, seq, _, outcome, _, _ in rows:
        if outcome == "ok":
            blocks[run] = 0
        elif outcome == "blocked":
            blocks[run] += 1
            if blocks[run] >= limit:
                expected.setdefault(run, seq)
    got = runs.abort_cutoff(spark.createDataFrame(rows, SCHEMA), limit, chunk_rows=chunk_rows).collect()
    assert {r.run_id: r.abort_seq for r in got} == expected


def test_cap_counts_earlier_spending(spark):
    log = spark.createDataFrame(random_log(5, n=90, n_runs=1), SCHEMA).withColumn("used_before", F.lit(8))
    stopped = runs.stop_runs(log, RunLimits(10, 99, None)).groupBy("run_id").count().collect()
    assert {r["count"] for r in stopped} == {2}


def test_runs_of_one_day_share_the_cap(spark):
    rows = [(f"r{i // 10}", "a", "q", i, f"u{i}", "ok", datetime(2025, 1, 1, 5), False) for i in range(30)]
    stopped = runs.stop_runs(spark.createDataFrame(rows, SCHEMA), RunLimits(12, 99, None))
    assert sorted((r.run_id, r["count"]) for r in stopped.groupBy("run_id").count().collect()) == [("r0", 10), ("r1", 2)]


def test_audit_counts_what_the_upsert_did(spark):
    rows = [("r", "a", "q", i, f"u{i}", "ok", datetime(2025, 1, 1, 5), False, s) for i, s in enumerate(("new", "updated", None, "new"))]
    limits = RunLimits(99, 99, None)
    audit = runs.summarize_runs(runs.stop_runs(spark.createDataFrame(rows, SCHEMA + ", stored STRING"), limits), limits)
    assert [(r.stored_new, r.stored_updated) for r in audit.collect()] == [(2, 1)]
    assert [(r.stored_new, r.runs) for r in runs.batch_totals(audit).where("query IS NULL").collect()] == [(2, 1)]


def test_daily_budget(spark):
    rows = [("r", "a", "q", i, f"u{i}", "ok", datetime(2025, 1, 1 + i // 6, 5), False) for i in range(12)]
    used = spark.createDataFrame([("a", datetime(2025, 1, 1).date(), 2)], "source STRING, day DATE, used INT")
    admitted = runs.within_budget(spark.createDataFrame(rows, SCHEMA), used, 5)
    assert sorted(r.seq for r in admitted.collect()) == [0, 1, 2, 6, 7, 8, 9, 10]


def test_budget_plan_keeps_few_rows_before_the_shuffle(spark):
    log = spark.createDataFrame(random_log(1, 50), SCHEMA)
    used = spark.createDataFrame([], "source STRING, day DATE, used INT")
    plan = runs.within_budget(log, used, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_requests_since_and_totals(spark):
    audit = spark.createDataFrame(
        [("a", 3, datetime(2025, 1, 2)), ("a", 4, datetime(2025, 1, 3)), ("b", 9, datetime(2024, 12, 1))],
        "source STRING, pages_visited LONG, started_at TIMESTAMP",
    )
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "source STRING")
    got = runs.requests_since(audit, listed, clock("2025-01-03T00:00:00Z")).collect()
    assert {r.source: r.used for r in got} == {"a": 4, "b": 0, "c": 0}


def test_progress(spark):
    old = spark.createDataFrame([("s", "q", "1"), ("s", "q", "2"), ("s", "p", "1")], "source STRING, query STRING, url STRING")
    new = spark.createDataFrame([("s", "q", "2"), ("s", "q", "3")], "source STRING, query STRING, url STRING")
    assert sorted(map(tuple, runs.merge_seen(old, new).collect())) == [("s", "p", "1"), ("s", "q", "1"), ("s", "q", "2"), ("s", "q", "3")]
    assert sorted(map(tuple, runs.replace_progress(old, new).collect())) == [("s", "p", "1"), ("s", "q", "2"), ("s", "q", "3")]
