from datetime import datetime

import pytest

from needwell import config
from needwell.functions import dates
from needwell.operators import discover
from needwell.sources import needs as need_source
from needwell.sources import search
from needwell.sources.pages import parse_pages, posts_from_pages

POST = "https://www.linkedin.com/posts/"

PAGES = {
    "described": (
        POST + "someone-else_1",
        """<html><head><!-- <meta property="og:description" content="from a comment"> -->
        <META content="Ida Berg on LinkedIn: We need tea &amp; &quot;cake&quot; > soon" property='og:description' />
        <meta property="og:title" content="the body again">
        <script type="application/ld+json">[{"a":{"datePublished":"2025-02-03T04:05:06.000Z"}}]</script></head>
        <body><a href="/jobs">j</a> <a class=x href="https://www.linkedin.com/in/ida?trk=1&amp;b=2">Ida</a></body></html>""",
        ("ok", "Ida Berg", None, "https://www.linkedin.com/in/ida", 'We need tea & "cake" > soon', datetime(2025, 2, 3, 4, 5, 6)),
    ),
    "title_only": (
        POST + "omar-haddad-9a8_2",
        '<meta name="og:title" content=" Tea wanted "><h2 class="big author-headline x">Cook <b>at</b> Oak</h2>'
        '<time datetime="2025-02-03">x</time><a href="//uk.linkedin.com/in/o">o</a>',
        ("ok", "Omar Haddad", "Cook at Oak", "https://uk.linkedin.com/in/o", "Tea wanted", datetime(2025, 2, 3)),
    ),
    "article": (
        POST + "eva_3",
        "<main>no</main><article class='a>b'><script>var x='<p>';</script><p>Tea</p><p>and&nbsp;cake</p></article>",
        ("ok", "Eva", None, None, "Tea and\xa0cake", None),
    ),
    "main": (POST + "eva_4", "<MAIN><h1>Hi</h1> there</MAIN>", ("ok", "Eva", None, None, "Hi there", None)),
    "long_name": (
        POST + "leo_5",
        '<meta property="og:description" content="one two three four five six seven eight on LinkedIn: body">'
        '<script type="application/ld+json">{"datePublished": "2025-01-01", }</script><time datetime="bad">',
        ("ok", "Leo", None, None, "body", None),
    ),
    "wall": (POST + "ann_6", "<title> Sign Up |\n LinkedIn </title><article>x</article>", ("blocked",) + (None,) * 5),
    "no_author": ("https://www.linkedin.com/feed/update/7", "<article>text</article>", ("parse_error",) + (None,) * 5),
    "no_text": (POST + "ann_8", "<p>oops</p>", ("parse_error",) + (None,) * 5),
    "null": (POST + "ann_9", None, ("parse_error",) + (None,) * 5),
    "blank_property": (
        POST + "ann_10",
        '<meta property="og:description" content=" "><meta name="og:description" content="by name"><article>art</article>',
        ("ok", "Ann", None, None, "art", None),
    ),
}


def test_pages(spark):
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in PAGES.items()], "k STRING, url STRING, html STRING")
    fields = ("outcome", "author_name", "author_headline", "author_profile_url", "post_text", "posted_at")
    got = {r.k: tuple(r[f] for f in fields) for r in parse_pages(df).collect()}
    for key, (_, _, expected) in PAGES.items():
        assert got[key] == expected, key


def test_posts_from_pages(spark):
    df = spark.createDataFrame(
        [(PAGES["main"][0], PAGES["main"][1], "n", 1, datetime(2025, 1, 1)), ("x", "", "n", 2, datetime(2025, 1, 1))],
        "url STRING, html STRING, need STRING, seq LONG, fetched_at TIMESTAMP",
    )
    (row,) = posts_from_pages(parse_pages(df), "web").collect()
    assert (row.source_url, row.data.author_name, row.data.platform) == (POST + "eva_4", "Eva", "linkedin_public")


ORGANIC = '{"organic":[{"link":"%sa?x=1"},{"link":5},{"link":null},3,{"link":"https://x.example"},{"link":"%sb"},{"link":"%sa"}]}' % (POST, POST, POST)
WEB = '{"web":{"results":[{"url":"%sb?y"},{"url":"%sc"}]}}' % (POST, POST)
HTML = '<a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.linkedin.com%2Fposts%2Fd%3Fz&amp;r=1">x</a><a href=\'/l/?q\'>y</a>'


def payload(spark, text, term_pos=0):
    return spark.createDataFrame([("s", "q", term_pos, text)], "source STRING, query STRING, term_pos INT, payload STRING")


def test_discovery(spark):
    found = search.keep_post_urls(
        discover.union_candidates(
            search.json_candidates(payload(spark, ORGANIC, 1), search.ORGANIC_SHAPE),
            search.json_candidates(payload(spark, WEB, 0), search.WEB_SHAPE),
            search.html_candidates(payload(spark, HTML, 2)),
        )
    )
    best = {r.url: (r.term_pos, r.rank) for r in discover.first_ranked(found).collect()}
    assert best == {POST + "a": (1, 0), POST + "b": (0, 0), POST + "c": (0, 1), POST + "d": (2, 0)}
    seen = spark.createDataFrame([("s", "q", POST + "a"), ("s", "other", POST + "b")], "source STRING, query STRING, url STRING")
    assert {r.url[-1] for r in discover.not_seen(discover.first_ranked(found), seen).collect()} == {"b", "c", "d"}


@pytest.mark.parametrize("bad", ["", "[]", "null", '{"organic":{"link":"x"}}', '{"organic":[', '{"web":[]}', None])
def test_malformed_payloads_give_no_rows(spark, bad):
    for shape in (search.ORGANIC_SHAPE, search.WEB_SHAPE):
        assert search.json_candidates(payload(spark, bad), shape).count() == 0


def test_needs_and_terms(spark):
    needs = need_source.needs_table(spark, ["  Tea shop", "TEA SHOP ", "", "cake"])
    assert sorted(map(tuple, needs.collect())) == [(0, "Tea shop"), (3, "cake")]
    terms = need_source.search_terms(needs, ["x {need} {need}", "y"])
    assert {(r.pos, r.term_pos, r.term) for r in terms.collect()} == {
        (0, 0, "x Tea shop Tea shop"), (0, 1, "y"), (3, 0, "x cake cake"), (3, 1, "y"),
    }
    for bad in ([], [" "], "x", [1]):
        with pytest.raises(ValueError):
            need_source.needs_table(spark, bad)
    with pytest.raises(ValueError):
        need_source.search_terms(needs, [])
    assert need_source.search_terms(need_source.needs_table(spark, config.NEEDS), config.SEARCH_TEMPLATES).count() == 90


def test_dates(apply):
    given = ["2025-01-02", "2025-01-02T03:04", "2025-01-02 03:04:05.5-02:30", " 2025-01-02T03:04:05Z ", "2025", "2025-1-2", "x", None]
    assert apply(dates.parse_iso, given) == [
        datetime(2025, 1, 2), datetime(2025, 1, 2, 3, 4), datetime(2025, 1, 2, 5, 34, 5, 500000),
        datetime(2025, 1, 2, 3, 4, 5), None, None, None, None,
    ]
    windows = ["1d", "7D", " 1 w", "8d", "1m", "31d", "32d", "1y", "0d", "d", "1h", None, "99999999999999999999d"]
    assert apply(dates.recency_bucket, windows) == ["d", "w", "w", "m", "m", "m", "y", "y", "d", None, None, None, None]


def test_iso_text(apply):
    assert apply(lambda c: dates.iso_text(dates.parse_iso(c)), ["2025-01-02T03:04:05.25Z", "2025-01-02"]) == [
        "2025-01-02T03:04:05.250000+00:00", "2025-01-02T00:00:00+00:00",
    ]


def test_terms_need_no_join(spark):
    needs = spark.createDataFrame([(0, "a")], "pos INT, need STRING")
    plan = need_source.search_terms(needs, ["x {need}"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_nested_elements_are_read_whole(apply):
    from needwell.functions import html

    pages = {
        "<p>x</p><article class='a'>A <article>B</article> C</article> D": "A B C",
        "<ARTICLE>A<article>B<article>C</article></article> tail</ARTICLE><article>no</article>": "A B C tail",
        "</article><article>open <b>end": "open end",
        "<main>m <main>n</main> o</main>": "m n o",
        "<article> </article><main>m</main>": None,
        "<p>none</p>": None,
    }
    assert apply(html.main_text, list(pages)) == list(pages.values())


def test_link_entities(apply):
    from needwell.functions import html

    page = "<a href='/x?a=1&amp;b=2'>1</a><a href=\"/y?q=&#233;&quot;&lt\">2</a><a>none</a><a href='/z\n?u=&copy;'>3</a>"
    plain = "<a href='/x?a=1&amp;b=2&c'>1</a>"
    assert apply(html.link_targets, [page, plain, "no links"]) == [["/x?a=1&b=2", '/y?q=é"<', "/z?u=©"], ["/x?a=1&b=2&c"], []]


def test_strings_of_a_key_at_any_depth(apply):
    from needwell.functions import html

    blocks = {
        r'{"d":"1","x":{"y":[{"d":"2"},["d",{"d":3,"e":"d"}]]},"d2":"no","a":{"d":{"d":"4"}}}': ["1", "2", "4"],
        r'{"x":"\"d\":\"no\"","\u0064":"a\u002db\/c","y\\":"d","d" : "\"5\""}': ["a-b/c", '"5"'],
        r'["d","d",{"z":"b","d":"1","a":{"d":"2"}},{"d":""}]': ["1", "2", ""],
        r'{"d":null,"e":{}}': [],
        '"d"': [],
    }
    assert apply(lambda c: html.json_strings(c, "d"), list(blocks)) == list(blocks.values())


def test_dates_of_posts(apply):
    from needwell.functions import html

    block = '<script type="application/ld+json">%s</script>'
    pages = {
        block % r'{"text":"\"datePublished\":\"2020-01-01\"","b":[{"z":{"date\u0050ublished":"2025\u002d02-03"}}]}': datetime(2025, 2, 3),
        block % '{"z":{"datePublished":"2025-02-04"},"a":{"datePublished":"2025-02-03"}}': datetime(2025, 2, 4),
        block % '{"datePublished":broken}' + block % '{"datePublished":"2025-02-05"}': datetime(2025, 2, 5),
        block % '{"datePublished":"soon"}' + "<time datetime='2025-02-06'>": datetime(2025, 2, 6),
        block % ('{"a":' * 50 + '{"datePublished":"2025-02-07"}' + "}" * 50): datetime(2025, 2, 7),
        block % ('{"t":"%s","datePublished":"2025-02-08"}' % (r"\"" * 100_000)): datetime(2025, 2, 8),
        "": None,
    }
    assert apply(html.posted_at, list(pages)) == list(pages.values())


def test_an_element_of_very_many_pieces(apply):
    from needwell.functions import html

    deep = "<article>a" * 30_000 + "</article>" * 30_000 + "<article>no</article>"
    (text,) = apply(html.main_text, [deep])
    assert text == " ".join("a" * 30_000)
