import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from needwell.functions import urls
from needwell.operators import company, names, rules
from needwell.operators.connect import connected


def test_merge_fills_gaps_and_unites_lists(spark):
    rows = spark.createDataFrame(
        [
            ("1", "Oak", "oak.example", None, "x@o", ["a", "b"], 3),
            ("2", "Oak Ltd", "OAK.example", "Ulm", "", ["b", "c"], None),
            ("3", "Fern", None, None, None, None, 1),
            ("4", "Fern", None, None, None, [], 1),
        ],
        "id STRING, business_name STRING, domain STRING, city STRING, email STRING, keywords ARRAY<STRING>, size INT",
    )
    got = {r.id: r for r in company.merge_companies(rows, "domain").collect()}
    assert set(got) == {"1", "3", "4"}
    assert (got["1"].business_name, got["1"].city, got["1"].email, got["1"].keywords) == ("Oak", "Ulm", "x@o", ["a", "b", "c"])
    assert got["3"].keywords == []
    assert [tuple(r) for r in company.merge_log(rows, "domain").collect()] == [("1", "2", "domain")]


def ratio(a: set, b: set) -> float:
    """The token-set ratio of two word sets, from the lengths of joined words."""
    size = lambda words: len(" ".join(sorted(words)))
    same, rest = size(a & b), min(size(a - b), size(b - a))
    return 0.0 if not same else 100.0 if not rest else 200 * same / (2 * same + 1 + rest)


def similar(rows, threshold):
    """Classes of equal names and pairs of them, by comparing all names of a place with each other."""
    sets, classes, pairs = {}, {}, {}
    for i, name, city, _ in sorted(rows):
        if tokens := frozenset(name.lower().split()):
            classes[i] = sets.setdefault((city.lower(), tokens), i)
    for ((city, a), i), ((other, b), j) in combinations(sets.items(), 2):
        if city == other and (r := ratio(a, b)) and r >= threshold - 1e-9:
            pairs[min(i, j), max(i, j)] = r
    return classes, pairs


@pytest.mark.parametrize(("seed", "threshold", "long_list"), [(0, 92, 500), (1, 92, 2), (2, 100, 5), (3, 70, 2)])
def test_similar_names_equal_brute_force(spark, seed, threshold, long_list):
    rng = random.Random(seed)
    pool = [f"{'w' * rng.randint(1, 9)}{i:02d}" for i in range(14)] + ["a", "of"]
    rows = []
    for i in range(150):
        words = rng.sample(pool, rng.choice([1, 2, 2, 3, 3, 4, 5, 9]))
        # one city holds most rows
        rows.append((f"c{i:03d}", " ".join(words).title(), rng.choice(["Ulm", "ulm", "Ulm", "Bonn"]), "de"))
    rows += [("d1", "", "Ulm", "de"), ("d2", " - ", "Ulm", "de"), ("d3", "Acme Group", "Ulm", "de"), ("d4", "Group ACME GmbH", "ulm", "de")]
    df = spark.createDataFrame([*rows, ("d5", None, "Ulm", "de")], "id STRING, business_name STRING, city STRING, country STRING")
    rows = [(i, n.replace("-", " "), c, k) for i, n, c, k in rows]
    classes, pairs = similar(rows, threshold)
    got = names.similar_names(df, threshold, long_list).collect()
    assert {(r.id_a, r.id_b): r.similarity for r in got} == pytest.approx(pairs)
    assert len(got) == len(pairs) and pairs["d3", "d4"] == 100
    links = {r.id: (r.class_id, r.links) for r in names.name_links(df, threshold).collect()}
    assert links == {i: (c, sum(c in p for p in pairs)) for i, c in classes.items()}


def test_a_frequent_word_makes_no_pairs(spark):
    """Thousands of names share a word, and each has one of its own: no list is compared with itself."""
    rows = [(f"i{i}", f"Group number{i}", "Ulm", "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "id STRING, business_name STRING, city STRING, country STRING")
    assert names.similar_names(df).isEmpty()
    more = df.union(spark.createDataFrame([("x", "Group", "Ulm", "de")], df.schema))
    assert names.name_links(more).where("id = 'x'").first().links == 3000


def components(nodes, pairs):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {n: root(n) for n in nodes if root(n) != n}


@pytest.mark.parametrize("seed", range(2))
def test_connected_equals_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(90)]
    chain = [f"z{i:03d}" for i in range(40)]
    rng.shuffle(chain)
    pairs += list(zip(chain, chain[1:], strict=False)) + [("star", f"leaf{i}") for i in range(30)] + [("self", "self")]
    nodes = {n for p in pairs for n in p}
    got = {r.node: r.label for r in connected(spark.createDataFrame(pairs, "a STRING, b STRING")).collect()}
    assert got == components(nodes, pairs)
    assert connected(spark.createDataFrame([], "a STRING, b STRING")).count() == 0


def test_links_of_later_passes_reach_back(spark):
    rows = spark.createDataFrame(
        [
            ("1", "Oak", None, "https://www.oak.co.uk/x", "Ulm", "de"), ("2", "Oak Works", "OAK.co.uk", None, "Ulm", "de"),
            ("3", "oak works", "works.co.uk", None, "ulm", "de"), ("4", "Fern Works", "works.co.uk", None, "Bonn", "de"),
            ("5", "Fern Works GmbH", None, None, "Bonn", "de"), ("6", "Moss", None, None, "Bonn", "de"), ("7", None, "", None, None, None),
        ],
        "id STRING, business_name STRING, domain STRING, website STRING, city STRING, country STRING",
    )
    kept, decisions = company.merge_connected(rows, rules.default_suffixes(spark))
    # 1-2 by domain, 2-3 by name, 3-4 by domain, 4-5 by similar names: one company, its fullest row stays
    got = {r.id: r for r in kept.collect()}
    assert set(got) == {"1", "6", "7"} and got["1"].business_name == "Oak"
    want = {("2", "1", "domain"), ("3", "1", "domain"), ("4", "1", "domain"), ("5", "1", "similar_name")}
    assert {(r.merged_id, r.kept_id, r.rule) for r in decisions.collect()} == want
    without, _ = company.merge_connected(rows, rules.default_suffixes(spark), fuzzy=None)
    assert "5" in {r.id for r in without.collect()}


def test_registered_domain_by_rules(spark):
    table = [*urls.PUBLIC_SUFFIXES, "*.ck", "!www.ck", "ru", "co.za"]
    suffixes = spark.createDataFrame([(s,) for s in table], "suffix STRING")
    expected = {
        "https://www.shop.co.uk/x": "shop.co.uk", "http://u@a.b.example.org:8/y": "example.org", "co.uk": None, "plain text": None,
        "https://host.zzz": None, "deep.site.com.au/path": "site.com.au", "a.b.c.ck": "b.c.ck", "c.ck": None, "x.www.ck": "www.ck",
        "https://one.ru": "one.ru", "a.two.co.za": "two.co.za", None: None, "": None,
    }
    df = spark.createDataFrame([(u,) for u in expected], "u STRING")
    assert {r.u: r.domain for r in rules.with_registered_domain(df, "u", suffixes).collect()} == expected


def test_phones_by_rules(spark):
    table = rules.default_dialling(spark).unionByName(spark.createDataFrame([("AE", "971", r"5\d{8}", "0")], "region STRING, code STRING, national STRING, trunk STRING"))
    expected = {
        "(212) 555-0101": ("+12125550101", "ok"), "+44 20 7946 0018": ("+442079460018", "ok"), "1-212-555-0101": ("+12125550101", "ok"),
        "12": (None, "invalid"), "abc": (None, "invalid"), "+1 111 555 0101": (None, "invalid"), "+971 50 123 4567": ("+971501234567", "ok"),
        "+7 495 123-45-67": (None, "no_rule"), None: (None, None), " ": (None, None),
    }
    df = spark.createDataFrame([(u,) for u in expected], "p STRING")
    assert {r.p: (r.phone_e164, r.phone_e164_state) for r in rules.with_phone(df, "p", table).collect()} == expected
    assert rules.with_phone(df, "p", table, region="ZZ").where("p = '12'").first().phone_e164_state == "no_rule"


def test_passes_chain_and_links_follow(spark):
    rows = spark.createDataFrame(
        [
            ("1", "Oak", None, "https://www.oak.co.uk/x", "Ulm"), ("2", "Oak Ltd", "oak.co.uk", None, "Ulm"),
            ("3", "oak", None, None, "ulm"), ("4", "Fern", None, "https://fern.zzz", "Bonn"), ("5", "Oak Ltd", None, None, "Ulm"),
        ],
        "id STRING, business_name STRING, domain STRING, website STRING, city STRING",
    )
    kept, decisions = company.merge_in_passes(rows, rules.default_suffixes(spark))
    # 1 takes in 2 by the domain of its website, then 3 by its own name
    assert {r.id for r in kept.collect()} == {"1", "4", "5"}
    assert {(r.merged_id, r.kept_id, r.rule) for r in decisions.collect()} == {("2", "1", "domain"), ("3", "1", "name_city")}
    leads = spark.createDataFrame([("a", "2"), ("b", None), ("c", "4")], "post_url STRING, lead_id STRING")
    assert {r.post_url: r.lead_id for r in company.repoint_links(leads, decisions).collect()} == {"a": "1", "b": None, "c": "4"}


def test_long_phrases_and_the_longest_one(spark):
    df = spark.createDataFrame(
        [("1", "x", "a long phrase of six given words", None, None), ("2", "a long phrase of six", "given words", [], "old"), ("3", "a long phrase of six given wordsmiths", "long", ["of six"], None)],
        "id STRING, business_name STRING, description STRING, keywords ARRAY<STRING>, industry STRING",
    )
    table = [("long phrase of six given words", "six"), ("long phrase", "two"), ("Long", "one"), ("of  SIX", "also"), ("of six", "again"), ("", "never"), ("--", "never")]
    taxonomy = spark.createDataFrame(table, "keyword STRING, industry STRING")
    found = company.phrases_found(df.select("id", F.explode(F.concat(F.array("business_name", "description"), F.coalesce("keywords", F.array().cast("array<string>")))).alias("field")), company.phrase_trie(taxonomy))
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add((r.phrase, r.industry))
    six = {("of six", "also"), ("of six", "again")}
    assert got == {"1": {("long phrase of six given words", "six"), *six}, "2": {("long phrase", "two"), *six}, "3": {("long phrase", "two"), ("long", "one"), *six}}
    assert company.classify_industry(df, taxonomy.limit(0)).where("id = '2'").first().industry == "old"


def test_industry_phrases(spark):
    df = spark.createDataFrame(
        [("1", "Web Design Oak", "we design the web", None, None), ("2", "Oak", "seo and web. design", ["Digital web   design"], "old"), ("3", None, "tea", [], "kept")],
        "id STRING, business_name STRING, description STRING, keywords ARRAY<STRING>, industry STRING",
    )
    taxonomy = spark.createDataFrame([("web design", "design"), ("SEO", "marketing"), ("digital web design", "marketing")], "keyword STRING, industry STRING")
    assert {r.id: r.industry for r in company.classify_industry(df, taxonomy).collect()} == {"1": "design", "2": "marketing", "3": "kept"}


def test_purge_covers_subdomains(spark):
    df = spark.createDataFrame([("1", "a.oak.example"), ("2", "oak.example.org"), ("3", None), ("4", "OAK.example")], "id STRING, host STRING")
    gone = spark.createDataFrame([("Oak.example",)], "domain STRING")
    assert {r.id for r in company.purge_domains(df, gone, [F.col("host")], "id").collect()} == {"2", "3"}


def test_purge_reaches_every_table(spark):
    leads = spark.createDataFrame(
        [("https://x.example/p", None, None, "Ann@mail.Oak.example"), ("https://x.example/q", None, "https://oak.example.org", None), ("https://oak.example:8/r", "", None, None)],
        "post_url STRING, author_profile_url STRING, website STRING, contact_email STRING",
    )
    rejects = spark.createDataFrame([("http://u@oak.example/x",), (None,), ("",)], "source_url STRING")
    left = company.purge_tables({"leads": leads, "rejects": rejects}, spark.createDataFrame([("OAK.example",)], "domain STRING"))
    assert [r.post_url for r in left["leads"].collect()] == ["https://x.example/q"]
    assert left["rejects"].count() == 2


def test_links(spark):
    leads = spark.createDataFrame([("p1", "ACME  studios", None), ("p2", None, "9"), ("p3", "Nope", None)], "post_url STRING, company STRING, lead_id STRING")
    dim = spark.createDataFrame([("1", "Acme Studios", "a.example"), ("2", "acme studios", "b.example")], "id STRING, business_name STRING, domain STRING")
    linked = company.link_companies(leads, dim)
    assert {r.post_url: r.lead_id for r in linked.collect()} == {"p1": "1", "p2": "9", "p3": None}
    cleared = company.clear_broken_links(linked, dim)
    assert {r.post_url: r.lead_id for r in cleared.collect()} == {"p1": "1", "p2": None, "p3": None}


def test_filters_reject_unknown_names(spark):
    df = spark.createDataFrame([("a", "X")], "id STRING, city STRING")
    assert company.filter_companies(df, city="x", country=None).count() == 1
    with pytest.raises(ValueError):
        company.filter_companies(df, colour="red")


def test_profiles_give_one_row_each_and_a_breakdown(spark):
    df = spark.createDataFrame(
        [("1", "Retail", "Ulm", "1-10", "w", None, ["shopify"], 50)],
        "id STRING, industry STRING, city STRING, company_size STRING, website STRING, email STRING, tech_stack ARRAY<STRING>, data_quality_score INT",
    )
    profiles = [
        {"name": "p", "weights": {"industry_match": 50, "has_email": 30, "data_quality": 20}, "industries": ["retail"]},
        {"name": "z", "weights": {}},
    ]
    got = {r.profile: r for r in company.score_profiles(df, profiles).collect()}
    assert got["p"].lead_score == 60 and got["p"].breakdown.data_quality == 10.0
    assert got["z"].lead_score == 0
