"""Ingest, upsert, snapshots, streaming, ranking and export."""

import csv
import json
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from needwell import schemas
from needwell.functions.dates import clock
from needwell.operators import buckets, company, ingest, merge, rank, rules, runs, score, store
from needwell.plans.export import export_leads
from needwell.sources.posts import enabled_sources, read_raw_posts
from needwell.streaming import ingest as stream

NOW = "2025-05-01T10:00:00Z"
LATER = "2025-05-02T10:00:00Z"


def post(seq, url, author="Ann Lee", text="We need a designer for our new tea shop.", need="designer", **data):
    fields = {"author_headline": None, "author_profile_url": None, "posted_at": None, "platform": None, **data}
    return ("web", url, datetime(2025, 5, 1), need, seq, {"author_name": author, "post_text": text, **fields})


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RAW_POSTS)


def ingest_rows(spark, *rows):
    return ingest.tag_posts(raw(spark, *rows))


def test_every_row_is_valid_or_rejected(spark):
    tagged = ingest_rows(
        spark,
        post(1, "u1"),
        post(2, "u2", author="  "),
        post(3, "u3", text=None),
        post(4, "u4", author="\U0001f680"),
        post(5, "u5", text="&nbsp;"),
    ).cache()
    assert ingest.valid_rows(tagged).count() == 1
    rejects = {r.source_url: (r.stage, r.reason) for r in ingest.reject_rows(tagged, clock(NOW)).collect()}
    assert rejects == {
        "u2": ("mapping", "missing author_name/post_text for u2"),
        "u3": ("mapping", "missing author_name/post_text for u3"),
        "u4": ("validation", "author name empty after cleaning"),
        "u5": ("validation", "post text empty after cleaning"),
    }


def test_quality_is_scored_before_enrichment(spark):
    row = ingest.valid_rows(ingest_rows(spark, post(1, "u", text="Oak Ltd is hiring people. Write to A@oak.example"))).first()
    assert (row.company, row.contact_email) == ("Oak Ltd", "a@oak.example")
    assert "missing_company" in row.quality_flags and row.platform == "linkedin_public"


def test_need_text_is_cut_before_cleaning(spark):
    row = ingest.valid_rows(ingest_rows(spark, post(1, "u", text="&amp;" * 200))).first()
    assert row.need_text == "&" * 100 and row.post_text == "&" * 200


def sequential_upsert(stored, arrivals):
    table = {k: dict(v) for k, v in stored.items()}
    for a in sorted(arrivals, key=lambda r: r["seq"]):
        row = table.setdefault(a["post_url"], {})
        for name, value in a.items():
            if value is not None and name != "seq":
                row[name] = value
    return table


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_row_by_row_merge(spark, seed):
    rng = random.Random(seed)
    texts = {"company": ["c1", "c2", None], "website": ["w1", None, None], "contact_email": ["e1", None], "author_headline": ["h", None]}

    def arrival(seq):
        # one key takes about a third of all arrivals
        url = "hot" if rng.random() < 0.35 else f"u{rng.randrange(12)}"
        row = {k: rng.choice(v) for k, v in texts.items()}
        return {
            "seq": seq, "post_url": url, "author_name": f"a{seq}", "author_profile_url": None, "need_text": "n",
            "need_category": f"need{seq % 3}", "post_text": f"t{seq}", "posted_at": None, "platform": "p",
            "data_quality_score": seq, "quality_flags": [f"f{seq}"] if seq % 2 else [], **row,
        }

    arrivals = [arrival(i) for i in range(60)]
    schema = "seq LONG, " + ", ".join(
        f"{c} {schemas.INTENT_LEADS[c].dataType.simpleString()}" for c in ingest.ARRIVAL_COLUMNS
    )
    rows = [tuple([a["seq"], *[a[c] for c in ingest.ARRIVAL_COLUMNS]]) for a in arrivals]
    valid = spark.createDataFrame(rows, schema)
    empty = spark.createDataFrame([], schemas.INTENT_LEADS)
    cut = 25
    once = merge.upsert(empty, valid.where(F.col("seq") < cut), clock(NOW))
    twice = merge.merge_arrivals(once, merge.reduce_arrivals(valid.where(F.col("seq") >= cut)), clock(LATER)).cache()
    expected = sequential_upsert({}, arrivals)
    got = {r.post_url: r for r in twice.collect()}
    assert set(got) == set(expected)
    for url, row in expected.items():
        for name, value in row.items():
            assert getattr(got[url], name) == value, (url, name)
        assert got[url].status == "new" and got[url].category == "unclear" and got[url].lead_score is None
    firsts = {a["post_url"] for a in arrivals if a["seq"] < cut}
    assert all((r.first_seen < datetime(2025, 5, 2)) == (u in firsts) for u, r in got.items())
    tally = merge.upsert_tally(twice).first()
    assert tally.stored_new == len(set(expected) - firsts)
    assert tally.stored_new + tally.stored_updated == 60 - cut


def test_upsert_keeps_scores_and_is_idempotent(spark):
    valid = ingest.valid_rows(ingest_rows(spark, post(1, "u1"), post(2, "u2", need="other"))).cache()
    stored = score.score_leads(merge.upsert(spark.createDataFrame([], schemas.INTENT_LEADS), valid, clock(NOW)), clock(NOW))
    again = merge.upsert(stored, valid, clock(LATER))
    assert again.exceptAll(stored).count() == 0  # nothing changed, not even last_updated
    moved = merge.upsert(stored, valid.withColumn("need_text", F.lit("new words")), clock(LATER))
    row = moved.where("post_url = 'u1'").first()
    assert (row.status, row.need_text) == ("scored", "new words")
    assert row.last_updated > row.first_seen and row.lead_score is not None


def test_store_round_trip_and_repeat(spark, tmp_path):
    root = str(tmp_path)
    assert store.store_batch(spark, root, raw(spark, post(1, "u1"), post(2, "u2", author="")), clock(NOW), "b1")
    assert not store.store_batch(spark, root, raw(spark, post(9, "u9")), clock(NOW), "b1")
    assert store.store_batch(spark, root, raw(spark, post(3, "u1", need="late"), post(4, "u3")), clock(LATER), "b2")
    leads = {r.post_url: r for r in store.read_leads(spark, root).collect()}
    assert set(leads) == {"u1", "u3"} and leads["u1"].need_category == "late"
    assert store.current_version(spark, root) == 2
    assert [r.source_url for r in store.read_rejects(spark, root).collect()] == ["u2"]


def test_a_batch_writes_what_it_touches(spark, tmp_path, monkeypatch):
    """Versions hold touched leads only, and make the table that whole rewrites make."""
    days = [f"2025-05-{d:02d}T10:00:00Z" for d in range(1, 6)]
    batches = [
        [post(i, f"u{i}", text=f"We need help number {i} with tea and cake.", author_headline="CEO @ Globex") for i in range(40)],
        [post(40, "u3", need="late"), post(41, "u3", text="We need a baker, write to a@b.example."), post(42, "new")],
        [post(43, "x1"), post(44, "x2", author="")],
        [post(45, "u3", need="later"), post(46, "new"), post(47, "x1", need="other")],
        [post(48, "", author="")],
    ]

    def run(root, numbers=range(len(batches))):
        for n in numbers:
            assert store.store_batch(spark, root, raw(spark, *batches[n]), clock(days[n]), f"b{n}")
        return store.read_leads(spark, root)

    root, whole = str(tmp_path / "s"), str(tmp_path / "w")
    leads = run(root, [0, 1, 2])
    # a batch that failed before its commit leaves files, which count for nothing
    spark.createDataFrame([("u5", 1)], "post_url STRING, of LONG").write.parquet(f"{root}/replaced/version=4")
    leads.limit(7).write.parquet(f"{root}/leads/version=4")
    assert store.read_leads(spark, root).count() == 42
    leads = run(root, [3, 4])
    sizes = [spark.read.parquet(f"{root}/leads/version={v}").count() for v in range(1, 6)]
    assert sizes == [40, 2, 1, 3, 0]
    monkeypatch.setattr(store, "LIVE_VERSIONS", 1)
    expected = run(whole)
    assert spark.read.parquet(f"{whole}/leads/version=5").count() == 42
    assert leads.count() == 42 and leads.exceptAll(expected).isEmpty() and leads.schema == expected.schema
    # a table written whole by others, in an older layout, is taken up by the next batch
    store.commit_leads(spark, root, leads.drop("status", "lead_score"), "import")
    monkeypatch.setattr(store, "LIVE_VERSIONS", 3)
    for n in range(6, 10):
        assert store.store_batch(spark, root, raw(spark, post(n, "u3"), post(n, f"n{n}")), clock(days[0]), f"b{n}")
    assert [spark.read.parquet(f"{root}/leads/version={v}").count() for v in range(6, 11)] == [42, 43, 2, 2, 46]
    after = store.read_leads(spark, root)
    assert after.count() == after.select("post_url").distinct().count() == 46


def test_bucketed_table_spares_the_big_shuffle(spark, tmp_path):
    valid = ingest.valid_rows(ingest_rows(spark, *[post(i, f"u{i}") for i in range(20)]))
    leads = merge.upsert(spark.createDataFrame([], schemas.INTENT_LEADS), valid, clock(NOW))
    store.save_bucketed(leads, "bucketed_leads", str(tmp_path / "t"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge.merge_arrivals(spark.table("bucketed_leads"), merge.reduce_arrivals(valid), clock(LATER))
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_leads")
    assert plan.count("Exchange hashpartitioning") == 1  # only the batch moves


def test_stream_equals_batch(spark, tmp_path):
    rows = [post(i, f"u{i % 7}", text=f"We need help number {i} with tea and cake.") for i in range(30)]
    rows.append(post(31, "bad", author=""))
    df = raw(spark, *rows)
    df.repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in"))
    stored = stream.read_posts(spark, str(tmp_path / "in"))
    stream.start_ingest(stored, str(tmp_path / "s"), str(tmp_path / "c"), lambda: clock(NOW)).awaitTermination()
    store.store_batch(spark, str(tmp_path / "b"), read_raw_posts(spark, str(tmp_path / "in")), clock(NOW), "one")
    streamed, batch = (store.read_leads(spark, str(tmp_path / d)) for d in ("s", "b"))
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count() == 7
    # running again without new files changes nothing
    stream.start_ingest(stored, str(tmp_path / "s"), str(tmp_path / "c"), lambda: clock(NOW)).awaitTermination()
    assert store.read_leads(spark, str(tmp_path / "s")).count() == 7


def test_feeds_share_a_store(spark, tmp_path):
    """Two feeds number their batches alike; none is taken for a repeat of the other."""
    for feed in ("a", "b"):
        raw(spark, *[post(i, f"{feed}{i}") for i in range(5)]).write.parquet(str(tmp_path / feed))
        rows = stream.read_posts(spark, str(tmp_path / feed))
        stream.start_ingest(rows, str(tmp_path / "s"), str(tmp_path / f"c-{feed}"), lambda: clock(NOW)).awaitTermination()
    assert store.read_leads(spark, str(tmp_path / "s")).count() == 10


def test_one_file_and_one_url_are_cleaned_by_all_cores(spark, tmp_path):
    rows = [post(i, "same", text=f"We need help number {i} with tea and cake.") for i in range(200)]
    raw(spark, *rows, post(200, "bad", author="")).coalesce(1).write.parquet(str(tmp_path / "in"))
    store.store_batch(spark, str(tmp_path), read_raw_posts(spark, str(tmp_path / "in")), clock(NOW), "b")
    staged = spark.read.parquet(str(tmp_path / "staged")).groupBy(F.input_file_name()).count().collect()
    assert len(staged) >= 4 and sum(r["count"] for r in staged) == 201 and max(r["count"] for r in staged) < 100
    lead = store.read_leads(spark, str(tmp_path)).first()
    assert (lead.post_url, lead.post_text) == ("same", "We need help number 199 with tea and cake.")
    assert store.read_rejects(spark, str(tmp_path)).count() == 1


def test_only_rejects_keep_their_payload(spark):
    tagged = ingest_rows(spark, post(1, "u1"), post(2, "u2", author="\U0001f680"), post(3, "u3", text=None), post(4, "u4")).cache()
    settled = ingest.settled(tagged)
    assert {r.seq: r.data is None for r in settled.collect()} == {1: True, 2: False, 3: False, 4: True}
    assert sorted(ingest.valid_rows(settled).collect()) == sorted(ingest.valid_rows(tagged).collect())
    key = lambda r: r.source_url
    rejects = sorted(ingest.reject_rows(settled, clock(NOW)).collect(), key=key)
    assert rejects == sorted(ingest.reject_rows(tagged, clock(NOW)).collect(), key=key) and len(rejects) == 2


def test_every_batch_has_a_file_per_core(spark, tmp_path):
    from workload.streams import BATCHES, _landed

    cores = spark.sparkContext.defaultParallelism
    assert _landed(spark.range(1000), str(tmp_path / "in"), "id") == cores
    assert len(list((tmp_path / "in").glob("part-*"))) == BATCHES * cores
    assert spark.read.parquet(str(tmp_path / "in")).count() == 1000


def test_rejects_follow_commits(spark, tmp_path):
    root = str(tmp_path)
    store.store_batch(spark, root, raw(spark, post(1, "u1", author="")), clock(NOW), "2025-05-01")
    (tmp_path / "rejects" / "batch=2025-05-01").rename(tmp_path / "rejects" / "batch=torn")
    assert store.read_rejects(spark, root).count() == 0


def test_missing_need_erases_nothing(spark):
    valid = ingest.valid_rows(ingest_rows(spark, post(1, "u1"), post(2, "u1")))
    valid = valid.withColumn("need_category", F.when(F.col("seq") == 1, F.col("need_category")))
    row = merge.upsert(spark.createDataFrame([], schemas.INTENT_LEADS), valid, clock(NOW)).first()
    assert row.need_category == ingest.valid_rows(ingest_rows(spark, post(1, "u1"))).first().need_category


def day_files(spark, path, days):
    for number, day in enumerate(days):
        rows = [("s", datetime(2025, 5, day, 12), f"u{day}-{i}") for i in range(10)] + [("s", datetime(2025, 5, day), "same")]
        df = spark.createDataFrame(rows, "source STRING, ts TIMESTAMP, url STRING").coalesce(1)
        df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_files_out_of_order_all_count(spark, tmp_path):
    rows = day_files(spark, str(tmp_path / "in"), [1, 9, 2, 3, 4])
    stream.start_daily_requests(rows, str(tmp_path / "d"), str(tmp_path / "c1")).awaitTermination()
    daily = stream.read_daily_requests(spark, str(tmp_path / "d")).collect()
    assert sorted((r.day_start.day, r.requests) for r in daily) == [(1, 11), (2, 11), (3, 11), (4, 11), (9, 11)]
    stream.start_first_arrivals(rows, str(tmp_path / "f"), str(tmp_path / "c2"), ["source", "url"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() == 51


def leads_for_ranking(spark):
    rows = [("a", 50, 1, "client_lead"), ("b", None, 5, "client_lead"), ("c", 50, 2, "client_lead"), ("d", 90, 1, "unclear"), ("e", 50, 2, "client_lead")]
    return spark.createDataFrame(
        [(i, i, s, datetime(2025, 1, d), None, c, i, i, "p") for i, s, d, c in rows],
        "id STRING, post_url STRING, lead_score INT, first_seen TIMESTAMP, posted_at TIMESTAMP, category STRING, author_name STRING, need_text STRING, platform STRING",
    )


def test_ranking_pages_and_filters(spark):
    leads = leads_for_ranking(spark)
    assert [r.id for r in rank.ranked(leads).collect()] == ["c", "e", "a", "b"]
    assert [r.id for r in rank.ranked(leads, "all", limit=2).collect()] == ["d", "c"]
    assert [r.id for r in rank.ranked(leads, cutoff=clock("2025-01-02T00:00:00Z")).collect()] == ["c", "e", "b"]
    assert rank.count_matching(leads, "unclear").first().n == 1
    whole = [r.id for r in rank.ranked(leads, "all").collect()]
    walked, last = [], None
    while True:
        part = (rank.ranked(leads, "all", limit=2) if last is None else rank.page_after(leads, last, 2)).collect()
        if not part:
            break
        walked += [r.id for r in part]
        last = part[-1].asDict()
    assert walked == whole
    assert [r.id for r in rank.page(leads, rank.rank_order(), limit=2, offset=3).collect()] == whole[3:5]
    assert [r.id for r in rank.page(leads, rank.rank_order(), offset=3).collect()] == whole[3:]
    assert [r.id for r in rank.page(leads, rank.rank_order()).collect()] == whole


def test_top_k_is_planned_as_such(spark):
    plan = rank.ranked(leads_for_ranking(spark), limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_export_files(spark, tmp_path):
    leads = leads_for_ranking(spark).withColumn("posted_at", F.when(F.col("id") == "a", clock("2025-02-03T04:05:06Z")))
    export_leads(leads, str(tmp_path / "csv"), limit=10)
    (part,) = Path(tmp_path / "csv").glob("part-*")
    with part.open(newline="") as handle:
        rows = list(csv.DictReader(handle))
    assert list(rows[0]) == list(rank.EXPORT_COLUMNS)
    assert [(r["post_url"], r["lead_score"], r["posted_at"]) for r in rows] == [
        ("c", "50", ""), ("e", "50", ""), ("a", "50", "2025-02-03T04:05:06+00:00"), ("b", "", ""),
    ]
    export_leads(leads, str(tmp_path / "json"), fmt="json", category="all", limit=1)
    (part,) = Path(tmp_path / "json").glob("part-*")
    assert json.loads(part.read_text())["post_url"] == "d"
    with pytest.raises(ValueError, match="unsupported export format"):
        export_leads(leads, str(tmp_path / "x"), fmt="txt")


def test_backfill_of_an_old_layout(spark):
    old = spark.createDataFrame([("i", "u", None)], "id STRING, post_url STRING, data_quality_score INT")
    row = merge.backfill(old).first()
    assert (row.category, row.data_quality_score, row.quality_flags, row.website) == ("unclear", 0, [], None)


def test_enabled_sources(spark):
    df = spark.createDataFrame([("a",), ("b",)], "source STRING")
    assert [r.source for r in enabled_sources(df, ("b", " ")).collect()] == ["b"]
    assert enabled_sources(df, ()).count() == 0


def test_explanations(spark):
    valid = ingest.valid_rows(ingest_rows(spark, post(1, "u1")))
    leads = merge.upsert(spark.createDataFrame([], schemas.INTENT_LEADS), valid, clock(NOW))
    b = score.explain_scores(leads, clock(NOW)).first().breakdown
    scored = score.score_leads(leads, clock(NOW)).first()
    assert (b.category, b.freshness, b.non_client_capped) == ("client_lead", 60, False)
    assert b.signals.request == ["we need"] and b.signals.target == ["designer"]
    blend = sum(b.weights[k] * b[k] for k in ("freshness", "need_match", "data_quality"))
    assert scored.lead_score == round(blend)


def bucket_files(path):
    return {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).glob("bucket=*/*.parquet")}


def test_a_batch_rewrites_touched_buckets_only(spark, tmp_path):
    path, n = str(tmp_path / "leads"), 16
    first = ingest.valid_rows(ingest_rows(spark, *[post(i, f"https://x.example/p{i}") for i in range(300)]))
    assert len(buckets.upsert_buckets(spark, path, first, clock(NOW), n)) == n
    before = bucket_files(path)
    second = ingest.valid_rows(
        ingest_rows(spark, post(1, "https://x.example/p5", author="Bo Ray"), post(2, "https://x.example/new"), post(3, "https://x.example/p5", posted_at=datetime(2025, 1, 1)))
    )
    touched = buckets.upsert_buckets(spark, path, second, clock(LATER), n)
    assert 1 <= len(touched) <= 2
    after = bucket_files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.parent.name for f in before} - {f.parent.name for f in same} == {f"bucket={b}" for b in touched}
    # the table is the one that a whole rewrite gives
    whole = merge.upsert(merge.upsert(spark.createDataFrame([], schemas.INTENT_LEADS), first, clock(NOW)), second, clock(LATER))
    left = buckets.read_buckets(spark, path).drop("bucket")
    assert left.exceptAll(whole).isEmpty() and whole.exceptAll(left).isEmpty()
    # again: nothing changes but the files
    buckets.upsert_buckets(spark, path, second, clock(LATER), n)
    assert buckets.read_buckets(spark, path).drop("bucket").exceptAll(whole).isEmpty()
    assert buckets.upsert_buckets(spark, path, second.limit(0), clock(LATER), n) == []


def rows_scanned(df):
    """Rows that the scan of a frame hands on, after row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    stack, found = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert plan is not None
    return found


def test_lookups_skip_what_cannot_match(spark, tmp_path):
    path, n = str(tmp_path / "leads"), 8
    rows = ingest.valid_rows(ingest_rows(spark, *[post(i, f"https://x.example/p{i}") for i in range(400)]))
    buckets.upsert_buckets(spark, path, rows, clock(NOW), n)
    url = "https://x.example/p77"
    by_url = buckets.lead_by_url(spark, path, url, n)
    ident = by_url.first()["id"]
    plan = by_url._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(post_url" in plan
    by_id = buckets.lead_by_id(spark, path, ident)
    assert by_id.first()["post_url"] == url
    # one bucket of eight, by its name and by its filter
    assert rows_scanned(by_url) < 150 and rows_scanned(by_id) < 150
    assert rows_scanned(buckets.lead_by_id(spark, path, "nobody")) == 0
    assert buckets.lead_by_url(spark, path, "https://x.example/none", n).isEmpty()


def test_first_arrivals_survive_restarts(spark, tmp_path):
    """Batches out of order, then a restart with repeats of all of them: the state knows every key."""
    inbox, out, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    rows = day_files(spark, inbox, [4, 1, 9, 1, 2])
    stream.start_first_arrivals(rows, out, progress, ["source", "url"]).awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == 4 * 10 + 1
    rows = day_files(spark, inbox, [9, 2, 5])
    query = stream.start_first_arrivals(rows, out, progress, ["source", "url"])
    query.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == first + 10 == got.select("source", "url").distinct().count()
    # a batch looks up its own rows: it reads nothing that is stored
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(updated) == 10 and all(p["numInputRows"] <= 11 for p in query.recentProgress)
    state = [p["stateOperators"][0] for p in query.recentProgress][-1]
    assert state["numRowsTotal"] == first + 10 and any("rocksdb" in name for name in state["customMetrics"])


def test_daily_counts_survive_restarts_and_feeds(spark, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        rows = day_files(spark, str(tmp_path / "in"), [9, 1, 1])
        stream.start_daily_requests(rows, out, str(tmp_path / "p")).awaitTermination()
    other = day_files(spark, str(tmp_path / "other"), [1])
    stream.start_daily_requests(other, out, str(tmp_path / "p2")).awaitTermination()
    daily = {r.day_start.day: r.requests for r in stream.read_daily_requests(spark, out).collect()}
    assert daily == {1: 4 * 11 + 11, 9: 2 * 11}


@pytest.mark.parametrize("window", [(0, None), (7, 19), (0, 1), (95, 200), (100, None), (100, 120)])
def test_global_ranks(spark, window):
    rng = random.Random(4)
    rows = [(f"i{i}", rng.choice([None, 1, 2, 3]), datetime(2025, 1, rng.randint(1, 3))) for i in range(100)]
    df = spark.createDataFrame(rows, "id STRING, lead_score INT, first_seen TIMESTAMP").repartition(4)
    whole = [r.id for r in df.orderBy(*rank.rank_order()).collect()]
    got = sorted((r.position, r.id) for r in rank.numbered(df, rank.rank_order(), *window).collect())
    first, end = window
    assert got == list(enumerate(whole))[first:end]


def test_pages_past_the_bound_go_by_rank(spark, monkeypatch):
    monkeypatch.setattr(rank, "TOP_ROWS", 2)
    leads = leads_for_ranking(spark)
    whole = [r.id for r in rank.ranked(leads, "all").collect()]
    pages = [rank.page(leads, rank.rank_order(), limit=2, offset=o) for o in (0, 2, 4)]
    assert [r.id for p in pages for r in p.collect()] == whole
    assert "TakeOrdered" not in pages[1].drop("x")._jdf.queryExecution().optimizedPlan().toString()
    assert rank.page(leads, rank.rank_order(), limit=3, offset=9).columns == leads.columns


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_inputs_are_read_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"k{i}" if i % 3 else None, f"https://a{i}.example.com/x", {"a": "b"}) for i in range(30)]
    spark.createDataFrame(rows, "n INT, k STRING, u STRING, m MAP<STRING, STRING>").write.parquet(path)
    df = spark.read.parquet(path)
    known = spark.createDataFrame([("k1", "one"), (None, "never")], "k STRING, v STRING")
    joined = rules.join_present(df, known, "k")
    assert scans(joined) == 1 and joined.columns == ["n", "k", "u", "m", "v"]
    assert sorted((r.n, r.k, r.v) for r in joined.collect()) == [(i, k, "one" if i == 1 else None) for i, k, _, _ in rows]
    # a rule table is looked up with the distinct values: one column of the input, and the input itself
    assert scans(rules.with_registered_domain(df, "u", rules.default_suffixes(spark))) == 2
    gone = spark.createDataFrame([("example.org",)], "domain STRING")
    leads = spark.createDataFrame([], schemas.INTENT_LEADS)
    leads.write.parquet(str(tmp_path / "leads"))
    left = company.purge_tables({"leads": spark.read.parquet(str(tmp_path / "leads"))}, gone)["leads"]
    assert scans(left) == 1 + 4  # the rows once, the purged hosts for each of four columns


def test_run_audit_of_a_written_log(spark):
    t = [datetime(2025, 1, 1, 0, m) for m in range(6)]
    rows = [
        ("r", "s", "q", 1, "ok", t[0], False, "new", "running", None), ("r", "s", "q", 2, "ok", t[1], True, None, "running", None),
        ("r", "s", "q", 5, "blocked", t[5], None, None, "aborted", "five blocks"), ("r", "s", "q", 3, "transient", t[2], None, None, "running", "x"),
        ("r", "s", "q", 4, "parse_error", t[3], None, None, "running", None), ("e", "s", "q", 9, "ok", t[0], None, "updated", None, None),
    ]
    log = spark.createDataFrame(rows, "run_id STRING, source STRING, query STRING, seq LONG, outcome STRING, ts TIMESTAMP, rejected BOOLEAN, stored STRING, status STRING, message STRING")
    got = {r.run_id: r for r in runs.audit_runs(log).collect()}
    r = got["r"]
    assert (r.status, r.error_message, r.pages_visited, r.leads_found, r.rejects, r.errors, r.stored_new, r.stored_updated) == ("aborted", "five blocks", 5, 2, 2, 1, 1, 0)
    assert r.duration_seconds == 300.0 and (got["e"].status, got["e"].stored_updated) == ("completed", 1)
    bare = runs.audit_runs(log.drop("rejected", "stored", "status", "message")).where("run_id = 'r'").first()
    assert (bare.status, bare.error_message, bare.rejects, bare.stored_new) == ("completed", None, 1, 0)
    plan = runs.audit_runs(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
