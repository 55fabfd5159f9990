from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from needwell import config
from needwell.config import ScoringConfig
from needwell.functions import classify, dates, lexicon, patterns, quality, scoring

# own sentences, one bucket each
POSTS = [
    ("Nora", "We need a designer for our cafe.", "client_lead"),
    ("Nora", "In need of an SEO expert, happy to share the budget.", "client_lead"),
    ("Nora", "Hello! Looking for a vendor who ships fast.", "client_lead"),
    ("Nora", "Drop me a note if you know a copywriter; I want help.", "client_lead"),
    ("Nora", "We’re hiring! Looking for a designer.", "job_posting"),
    ("Nora", "Send us your CV, we need a developer", "job_posting"),
    ("Nora", "We are looking for a cook, with heart, to join our kitchen", "job_posting"),
    ("Nora", "Looking for an editor who wants to join soon", "recruiter_staffing"),
    ("Nora", "Growing our bench of writers", "recruiter_staffing"),
    ("Nora", "mail cv@acme-talent.example", "recruiter_staffing"),
    ("Sun Media", "We need a designer", "competitor_selfpromo"),
    ("Nora", "7 tips: we need help", "competitor_selfpromo"),
    ("Nora", "Pro tip: we need help sometimes", "content_noise"),
    ("Nora", "2023: we need an agency", "content_noise"),
    ("Nora", "We need sleep", "unclear"),
    ("Nora", "anyone looking for a designer knows", "unclear"),
    (None, None, "unclear"),
]


def test_categories(apply):
    got = apply(lambda a, t: classify.category(t, a), [(a, t) for a, t, _ in POSTS])
    assert got == [c for *_, c in POSTS]


def test_request_flag_ignores_junk(apply):
    assert apply(classify.has_request, ["We're hiring, we need a developer", "we need tea", None]) == [True, False, False]


def test_hits_are_collapsed_lowered_and_unique(apply):
    hits = apply(lambda t: classify.signal_hits(t, lexicon.REQUEST), ["We  NEED it. we need a", "x"])
    assert hits == [["we need"], []]


def test_grouped_form_finds_what_single_patterns_find(apply):
    texts = [t.lower() for _, t, _ in POSTS if t]
    for group in lexicon.GROUPS.values():
        whole = apply(lambda c: classify.occurs(c, group), texts)  # noqa: B023
        single = apply(
            lambda c: F.exists(F.array(*[c.rlike(patterns.jvm(p)) for p in group]), lambda hit: hit),  # noqa: B023
            texts,
        )
        assert whole == single


NOW = "2025-03-10T12:00:00Z"


def freshness(apply, posted, seen, cfg=ScoringConfig()):
    def fn(p, s):
        return scoring.freshness_details(dates.parse_iso(p), dates.parse_iso(s), dates.clock(NOW), cfg)

    return apply(fn, [(posted, seen)])[0]


@pytest.mark.parametrize(
    ("posted", "seen", "score", "fallback"),
    [
        (NOW, NOW, 100, False),
        ("2025-03-06T12:00:00Z", NOW, 50, False),
        ("2025-03-02T12:00:00", NOW, 25, False),
        ("2025-04-01", NOW, 100, False),
        (None, NOW, 60, True),
        (None, "2025-03-06T12:00:00Z", 30, True),
        (None, None, 0, True),
    ],
)
def test_freshness(apply, posted, seen, score, fallback):
    got = freshness(apply, posted, seen)
    assert (got.score, got.used_fallback) == (score, fallback)


def test_freshness_follows_python_rounding(apply):
    now = datetime(2025, 3, 10, 12)
    for hours in (1, 5, 31, 77, 240, 1000):
        posted = (now - timedelta(hours=hours)).isoformat()
        assert freshness(apply, posted, None).score == round(100 * 0.5 ** (hours / 24 / 4))


def test_zero_half_life_is_guarded(apply):
    assert freshness(apply, "2025-03-01", None, ScoringConfig(freshness_half_life_days=0)).score == 0


def need(spark, need_text, post, cfg=ScoringConfig()):
    df = spark.createDataFrame([(need_text, post)], "need STRING, post STRING")
    low = df.withColumn("low", classify.lowered(F.col("post")))
    return scoring.with_need_match(low, "low", "need", "m", cfg).first().m


@pytest.mark.parametrize(
    ("need_text", "post", "score"),
    [
        ("tea shop", "I want a TEA SHOP", 100),
        ("tea shop", "a tea shop", 70),
        ("tea shop", "shop for tea", 50),
        ("tea shop", "need shop tea", 80),
        ("tea shop", "tea only", 20),
        ("tea shop", "want tea", 35),
        ("tea shop", "coffee, hire me", 10),
        ("seo", "seoul needed", 70),
        ("the of", "the end of it", 50),
        ("a b c d", "want d", 28),
        ("one two three", "need one", 28),
        (None, "x", 0),
        (" ", "x", 0),
        ("tea", None, 0),
        ("éé", "éé", 0),
    ],
)
def test_need_match(spark, need_text, post, score):
    assert need(spark, need_text, post).score == score


def test_need_match_rounds_half_to_even(spark):
    cfg = ScoringConfig(need_topic_floor=12.5)
    assert need(spark, "tea", "coffee", cfg).score == 12


def test_quality_levels(apply):
    def fn(name, doubtful, headline, company, post, posted, profile):
        return quality.quality(name, doubtful == "y", headline, company, post, dates.parse_iso(posted), profile)

    full = ("Ann", "n", "h", "c", "long enough text here", "2025-01-01", "https://x.example")
    got = apply(fn, [full, ("Ann", "y", None, "", "short", None, "x"), ("", "y", None, None, None, None, None)])
    assert [g.score for g in got] == [100, 30, 0]
    assert got[0].flags == []
    assert got[1].flags == [
        "author_name_low_confidence", "post_text_short", "missing_posted_at",
        "invalid_author_profile_url", "missing_headline", "missing_company",
    ]
    assert got[2].flags[:2] == ["missing_author_name", "missing_post_text"]


def test_lead_score_blend_cap_and_clamp(apply):
    def fn(category, fresh, match, q):
        return scoring.lead_score(category, fresh, match, q)

    rows = [("client_lead", 50, 80, 90), ("job_posting", 100, 100, 100), ("client_lead", 100, 100, 400)]
    assert apply(fn, rows, ["string", "int", "int", "int"]) == [70, 0, 100]

    def capped(category, fresh):
        return scoring.lead_score(category, fresh, fresh, fresh, ScoringConfig(non_client_score_cap=7))

    assert apply(capped, [("unclear", 90), ("unclear", 3)], ["string", "int"]) == [7, 3]


def test_config_overlay():
    assert ScoringConfig.overlay(None) == ScoringConfig.overlay({"scoring": None}) == ScoringConfig()
    assert ScoringConfig.overlay({"need_topic_floor": 3, "other": "x"}).need_topic_floor == 3.0
    assert ScoringConfig.from_yaml("/nonexistent.yaml") == ScoringConfig()
    for bad in ({"need_topic_floor": "x"}, {"scoring": {"need_topic_floor": True}}, [1], {"scoring": [1]}):
        with pytest.raises(ValueError):
            ScoringConfig.overlay(bad)
    assert ScoringConfig(0, 0, 0, 0, 0).weights() == pytest.approx((1 / 3, 1 / 3, 1 / 3))


def test_category_choice():
    assert config.resolve_category(" ALL ") is None
    assert config.resolve_category("Unclear") == "unclear"
    with pytest.raises(ValueError):
        config.resolve_category("spam")


def test_every_match_has_a_plain_string_of_its_pattern(apply):
    """Texts made of the patterns' own words: guarded and unguarded searches find the same."""
    import random
    import re

    rng = random.Random(3)
    words = [*re.findall(r"[a-z]+", " ".join(p for g in lexicon.GROUPS.values() for p in g)), "7", "2024", "٣", "we’re", "é", "x_", ".", "\n", ":", "@a.hire.b"]
    texts = [rng.choice([" ", " ", "  ", ""]).join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(400)]
    texts += [t.lower() for _, t, _ in POSTS if t] + ["٣ tips", "need a", "a need a", "éneed a"]
    for group in lexicon.GROUPS.values():
        assert patterns.needles(tuple(group))
        got = apply(lambda c: classify.signal_hits(c, group), texts)  # noqa: B023
        plain = apply(
            lambda c: F.array_distinct(F.filter(F.array(*[F.trim(F.regexp_replace(F.regexp_extract(c, patterns.jvm(p), 0), r"(?U)\s+", " ")) for p in group]), lambda h: h != "")),  # noqa: B023
            texts,
        )
        assert got == plain


def test_patterns_without_a_required_string_are_searched_everywhere(apply):
    assert patterns.needles((r"\b\d+\b", "need")) is None
    assert apply(lambda c: classify.occurs(c, (r"\b(?:a|7)?\w+",)), ["x7", "!"]) == [True, False]


def test_characters_that_nfkc_may_change(apply):
    from needwell.functions import text

    stable = ["", "abc\n", "é ü", "Привет", "漢字\n", "á"[:1]]
    assert apply(text._may_change_under_nfkc, [*stable, "ﬁ", "abc ﬁ\n", "é́", "漢Ａ"]) == [False] * len(stable) + [True] * 4


def test_ranked_queries_classify_no_lead_twice(spark, monkeypatch):
    """The classifier isn't part of the plan that filters and sorts: its results are on disk by then."""
    from workload import leads

    rows = [("a", "u1", "We need a designer", 5), ("b", "u2", "salary", 4), ("c", "u3", "We need help", 9)]
    df = spark.createDataFrame(rows, "author_name string, post_url string, post_text string, lead_score int")
    seen = dates.clock("2024-01-30T00:00:00Z")
    df = df.withColumns({"need_text": F.lit("n"), "platform": F.lit("p"), "posted_at": seen, "first_seen": seen, "id": F.col("post_url")})
    df = df.withColumn("category", classify.category(F.col("post_text"), F.col("author_name")))
    monkeypatch.setattr(leads, "rescored", lambda *_: df)
    top = leads.ranked_leads(spark, "")
    assert [r["post_url"] for r in top.collect()] == ["u3", "u1"]
    assert "salary" not in top._jdf.queryExecution().optimizedPlan().toString()
    assert leads.filtered_count(spark, "").collect()[0]["n"] == 1
    assert leads.all_but_the_first_leads(spark, "").collect() == []
