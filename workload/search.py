"""Search results, URLs and saved pages derived from the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.config import NEEDS, SEARCH_TEMPLATES, Platform
from needwell.functions import html as h
from needwell.functions import urls
from needwell.operators import discover, rules
from needwell.session import spread
from needwell.sources import needs as need_source
from needwell.sources import search
from needwell.sources.pages import parse_pages
from workload import dialect as q
from workload.registry import query, table
from workload.text import normalize_sql
from workload.views import choose

PLATFORM = Platform()

# --- URL functions over the page table -----------------------------------------

URL_FORMS = (
    "{u}",
    " {u}&fbclid=1&Q=a b&r=%7Ex ",
    "{u}?a&b=&c=1%2B2&trk=9&Ref=x",
    "ftp://{n}.example.org/x",
    "HTTPS://User@Host{n}.Example.ORG:8080/Keep/Case?UTM_x=1&k=v#f",
    "not a url",
    "",
)


def url_forms() -> F.Column:
    form = choose(URL_FORMS, "page_id")
    return F.replace(F.replace(form, F.lit("{u}"), F.col("url")), F.lit("{n}"), F.col("page_id").cast("string"))


_FORMS_SQL = (
    "forms",
    f"""SELECT page_id, url, replace(replace({q.pick(URL_FORMS, 'page_id')}, '{{u}}', url), '{{n}}', page_id::VARCHAR) AS raw FROM pages""",
)
_TIDY_SQL = ("tidy", f"SELECT *, {q.strip('raw')} AS u FROM forms")


@query(
    "url_normalization",
    rf"""{q.with_ctes(_FORMS_SQL, _TIDY_SQL)} SELECT page_id, {normalize_sql('u')} AS normalized,
      regexp_matches(u, '(?i)^https?://[^/?#]+') AS valid, split_part(url, '?', 1) AS canonical,
      lower(regexp_extract(raw, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)) AS location FROM tidy""",
)
def url_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, normal form, canonical form and host of every page URL."""
    p = table(spark, sf_dir, "pages").withColumn("raw", url_forms())
    return p.select(
        "page_id",
        urls.normalize_url(F.col("raw")).alias("normalized"),
        urls.is_valid_url(F.col("raw")).alias("valid"),
        urls.canonical_post_url(F.col("url")).alias("canonical"),
        urls.network_location(F.col("raw")).alias("location"),
    )


@query(
    "registered_domains",
    r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'example.com', 'shop.co.uk') WHEN 1 THEN url
        WHEN 2 THEN 'just text' ELSE regexp_replace(url, 'example\.(com|net|org)', CASE WHEN page_id % 8 = 3 THEN 'unknown.zzz' ELSE 'shop.zzz.ck' END) END AS u FROM pages),
    d AS (SELECT page_id, string_split(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), '.') AS l FROM p)
    SELECT page_id, CASE WHEN len(l) > 2 AND l[-2] = 'zzz' AND l[-1] = 'ck' THEN l[-3] || '.zzz.ck' WHEN len(l) > 2 AND l[-2] || '.' || l[-1] = 'co.uk' THEN l[-3] || '.co.uk'
      WHEN len(l) > 1 AND l[-1] IN ('com', 'net', 'org') THEN l[-2] || '.' || l[-1] END AS domain FROM d""",
)
def registered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered domain by the longest suffix rule, a wildcard rule among them."""
    u = F.col("url")
    form = F.col("page_id") % 4
    other = F.when(F.col("page_id") % 8 == 3, "unknown.zzz").otherwise("shop.zzz.ck")
    changed = (
        F.when(form == 0, F.replace(u, F.lit("example.com"), F.lit("shop.co.uk")))
        .when(form == 1, u)
        .when(form == 2, "just text")
        .otherwise(F.regexp_replace(u, F.lit(r"example\.(com|net|org)"), other))
    )
    p = table(spark, sf_dir, "pages").select("page_id", changed.alias("u"))
    suffixes = rules.default_suffixes(spark).unionByName(spark.createDataFrame([("*.ck",)], "suffix STRING"))
    return rules.with_registered_domain(p, "u", suffixes).select("page_id", "domain")


PROFILE_FORMS = ("//www.linkedin.com/in/a{n}", "/in/b{n}?x=1", "https://uk.linkedin.com/in/c{n}?trk=2", "in/d", "/company/{n}", "mailto:/in/")
SLUG_FORMS = (
    "https://www.linkedin.com/posts/paul-mc-carron-79785053_hiring-{n}?utm=1",
    "https://www.linkedin.com/posts/ANNA--lee-8aa{n}_x",
    "https://www.linkedin.com/posts/{n}_x",
    "https://www.linkedin.com/feed/update/{n}",
    "https://www.linkedin.com/posts/maria#top",
)


@query(
    "profile_and_slug",
    rf"""WITH p AS (SELECT page_id, replace({q.pick(PROFILE_FORMS, 'page_id')}, '{{n}}', page_id::VARCHAR) AS f,
        replace({q.pick(SLUG_FORMS, 'page_id')}, '{{n}}', page_id::VARCHAR) AS s FROM pages),
    w AS (SELECT *, trim(regexp_replace(regexp_extract(s, '^https://[^/]*[^?#]*?/posts/([^/?#_]*)', 1), '-+', '-', 'g'), '-') AS words FROM p),
    k AS (SELECT *, string_split(regexp_replace(words, '(?:(?:^|-)[^-]*[0-9][^-]*)+$', ''), '-') AS parts FROM w)
    SELECT page_id, CASE WHEN NOT contains(f, '/in/') THEN NULL WHEN f LIKE '//%' THEN 'https:' || f
        WHEN f LIKE '/%' THEN 'https://www.linkedin.com' || f WHEN f LIKE 'http%' THEN split_part(f, '?', 1) END AS profile,
      nullif(array_to_string(list_transform(parts, lambda x: upper(x[1]) || lower(x[2:])), ' '), '') AS author FROM k""",
)
def profile_and_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile links made absolute and author names read from post URLs."""
    n = F.col("page_id").cast("string")
    href = F.replace(choose(PROFILE_FORMS, "page_id"), F.lit("{n}"), n)
    post = F.replace(choose(SLUG_FORMS, "page_id"), F.lit("{n}"), n)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.absolute_profile_url(href, PLATFORM).alias("profile"),
        urls.author_from_slug(post).alias("author"),
    )


# --- search results ---------------------------------------------------------------

_ORGANIC = (
    '{"organic":[{"link":"URL","position":1},{"link":"https://www.linkedin.com/posts/ann-A_x?utm=1"},{"link":N},'
    '{"title":"none"},{"link":"https://WWW.LinkedIn.com/feed/update/B?a=b#c"},7,{"link":{"u":"https://www.linkedin.com/posts/no"}},'
    '{"link":"https://www.linkedin.com/company/acme"}]}'
)
_WEB = '{"type":"search","web":{"results":[{"url":"https://www.linkedin.com/posts/bea-A_y"},{"url":null},{"url":"URL"},{"url":"https://www.linkedin.com/posts/ann-A_x"}]}}'
_BROKEN = ('{"organic": {"link": "https://www.linkedin.com/posts/not-a-list"}}', '{"organic": [', "[]", '{"web": "none"}')
_ANCHORS = (
    '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.linkedin.com%2Fposts%2Fann-A_x%3Futm%3Dshare&amp;rut=abc">one</a>'
    '<a href="/l/?kh=1&amp;uddg=https%3A%2F%2Fwww.linkedin.com%2Fposts%2Fcy%252Dlee-B_z">two</a>'
    '<a href="//www.linkedin.com/posts/dan-A_w?x">three</a><a href="">none</a>'
)


def _fill(template: F.Column | str) -> F.Column:
    text = F.lit(template) if isinstance(template, str) else template
    for mark, value in (
        ("URL", F.col("url")),
        ("ann-A", F.concat(F.lit("ann-"), (F.col("page_id") % 40).cast("string"))),
        ("bea-A", F.concat(F.lit("bea-"), (F.col("page_id") % 31).cast("string"))),
        ("dan-A", F.concat(F.lit("dan-"), (F.col("page_id") % 17).cast("string"))),
        ("lee-B", F.concat(F.lit("lee-"), (F.col("page_id") % 13).cast("string"))),
        ("update/B", F.concat(F.lit("update/"), (F.col("page_id") % 25).cast("string"))),
        (":N}", F.concat(F.lit(":"), F.col("page_id").cast("string"), F.lit("}"))),
    ):
        text = F.replace(text, F.lit(mark), value)
    return text


def _fill_sql(template: str) -> str:
    text = template
    for mark, value in (
        ("URL", "url"),
        ("ann-A", "'ann-' || (page_id % 40)"),
        ("bea-A", "'bea-' || (page_id % 31)"),
        ("dan-A", "'dan-' || (page_id % 17)"),
        ("lee-B", "'lee-' || (page_id % 13)"),
        ("update/B", "'update/' || (page_id % 25)"),
        (":N}", "':' || page_id || '}'"),
    ):
        text = f"replace({text}, {q.lit(mark)}, {value})"
    return text


def payloads(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """One saved search result per page: run keys, term position and payload."""
    p = table(spark, sf_dir, "pages")
    broken = choose(_BROKEN, "page_id")
    if shape == "html":
        payload = F.replace(F.col("html"), F.lit("</nav>"), F.concat(_fill(_ANCHORS), F.lit("</nav>")))
    else:
        good = _fill(_ORGANIC if shape == "organic" else _WEB)
        payload = F.when(F.col("page_id") % 9 == 4, broken).otherwise(good)
    return p.select(
        "page_id",
        F.concat(F.lit("engine"), (F.col("page_id") % 3).cast("string")).alias("source"),
        choose(NEEDS[:4], "page_id").alias("query"),
        (F.col("page_id") % 6).cast("int").alias("term_pos"),
        payload.alias("payload"),
    )


def _payload_sql(shape: str) -> tuple[str, str]:
    if shape == "html":
        payload = f"replace(html, '</nav>', {_fill_sql(q.lit(_ANCHORS))} || '</nav>')"
    else:
        good = _fill_sql(q.lit(_ORGANIC if shape == "organic" else _WEB))
        payload = f"CASE WHEN page_id % 9 = 4 THEN {q.pick(_BROKEN, 'page_id')} ELSE {good} END"
    return (
        f"{shape}_payloads",
        f"""SELECT page_id, 'engine' || (page_id % 3) AS source, {q.pick(NEEDS[:4], 'page_id')} AS query,
          (page_id % 6)::INTEGER AS term_pos, {payload} AS payload FROM pages""",
    )


def _json_sql(shape: str, path: str, field: str) -> tuple[str, str]:
    return (
        shape,
        f"""SELECT page_id, source, query, term_pos, i::INTEGER AS rank,
          json_extract_string(payload, '{path}[' || i || '].{field}') AS url
        FROM (SELECT *, unnest(range(json_array_length(payload, '{path}')::BIGINT)) AS i
              FROM {shape}_payloads WHERE json_valid(payload) AND json_type(payload, '{path}') = 'ARRAY')
        WHERE json_type(payload, '{path}[' || i || '].{field}') = 'VARCHAR'""",
    )


_HREFS = """list_filter(list_transform(regexp_extract_all(payload, '<a\\s[^>]*href="([^"]*)"', 1),
    lambda x: replace(x, '&amp;', '&')), lambda x: x <> '')"""
_UNWRAPPED = r"""CASE WHEN (contains(u, 'duckduckgo.com/l/') OR u LIKE '/l/%') AND regexp_extract(u, '[?&]uddg=([^&#]+)', 1) <> ''
    THEN url_decode(url_decode(replace(regexp_extract(u, '[?&]uddg=([^&#]+)', 1), '+', ' ')))
    WHEN u LIKE '//%' THEN 'https:' || u ELSE u END"""
_HTML_SQL = (
    "html_links",
    f"""SELECT page_id, source, query, term_pos, i::INTEGER AS rank, {_UNWRAPPED} AS url FROM (
      SELECT page_id, source, query, term_pos, unnest({_HREFS}) AS u, unnest(range(len({_HREFS}))) AS i FROM html_payloads)""",
)
_POSTS_ONLY = "regexp_matches(url, '(?i)linkedin\\.com/(posts|feed/update)/')"


def _kept(candidates: DataFrame) -> DataFrame:
    return search.keep_post_urls(candidates, PLATFORM)


@query(
    "organic_candidates",
    f"""{q.with_ctes(_payload_sql('organic'), _json_sql('organic', '$.organic', 'link'))}
    SELECT page_id, source, query, term_pos, rank, split_part(url, '?', 1) AS url FROM organic WHERE {_POSTS_ONLY}""",
)
def organic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post URLs from the first JSON shape."""
    return _kept(search.json_candidates(payloads(spark, sf_dir, "organic"), search.ORGANIC_SHAPE))


@query(
    "web_candidates",
    f"""{q.with_ctes(_payload_sql('web'), _json_sql('web', '$.web.results', 'url'))}
    SELECT page_id, source, query, term_pos, rank, split_part(url, '?', 1) AS url FROM web WHERE {_POSTS_ONLY}""",
)
def web_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post URLs from the second JSON shape."""
    return _kept(search.json_candidates(payloads(spark, sf_dir, "web"), search.WEB_SHAPE))


@query(
    "html_candidates",
    f"""{q.with_ctes(_payload_sql('html'), _HTML_SQL)} SELECT page_id, source, query, term_pos, rank, url FROM html_links""",
)
def html_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of result pages, redirects unwrapped."""
    return search.html_candidates(payloads(spark, sf_dir, "html"), platform=PLATFORM)


_ALL_SQL = (
    _payload_sql("organic"),
    _json_sql("organic", "$.organic", "link"),
    _payload_sql("web"),
    _json_sql("web", "$.web.results", "url"),
    _payload_sql("html"),
    _HTML_SQL,
    (
        "candidates",
        f"""SELECT source, query, term_pos, rank, split_part(url, '?', 1) AS url FROM (
          SELECT source, query, term_pos, rank, url FROM organic
          UNION ALL SELECT source, query, term_pos, rank, url FROM web
          UNION ALL SELECT source, query, term_pos, rank, url FROM html_links) WHERE {_POSTS_ONLY}""",
    ),
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (
        search.json_candidates(payloads(spark, sf_dir, "organic"), search.ORGANIC_SHAPE),
        search.json_candidates(payloads(spark, sf_dir, "web"), search.WEB_SHAPE),
        search.html_candidates(payloads(spark, sf_dir, "html"), platform=PLATFORM),
    )
    return _kept(discover.union_candidates(*[p.drop("page_id") for p in parts]))


@query(
    "discovered_urls",
    f"""{q.with_ctes(*_ALL_SQL)} SELECT source, query, url, term_pos, rank FROM candidates
    QUALIFY row_number() OVER (PARTITION BY source, query, url ORDER BY term_pos, rank) = 1""",
)
def discovered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all shapes and terms, each URL once per run at its best position."""
    return discover.first_ranked(candidates(spark, sf_dir))


@query(
    "resumed_urls",
    f"""{q.with_ctes(*_ALL_SQL)} SELECT DISTINCT source, query, url FROM candidates c WHERE NOT EXISTS (
      SELECT 1 FROM candidates s WHERE s.term_pos = 0 AND s.source = c.source AND s.query = c.query AND s.url = c.url)""",
)
def resumed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered URLs minus the ones a resumed run has seen."""
    found = candidates(spark, sf_dir)
    seen = found.where("term_pos = 0")
    return discover.not_seen(discover.first_ranked(found), seen).select("source", "query", "url")


# --- needs and terms ---------------------------------------------------------------

_NEED_SQL = f"""SELECT * FROM (SELECT doc_id AS pos, {q.strip("CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 2 = 0 THEN upper(source) ELSE ' ' || source || ' ' END")} AS need
      FROM documents) WHERE need <> '' QUALIFY row_number() OVER (PARTITION BY lower(need) ORDER BY pos) = 1"""


def _document_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    need = (
        F.when(d % 5 == 0, "  ")
        .when(d % 2 == 0, F.upper("source"))
        .otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    )
    listed = table(spark, sf_dir, "documents").select(d.alias("pos"), need.alias("need"))
    return need_source.distinct_needs(listed)


@query("distinct_needs", _NEED_SQL)
def distinct_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs without blanks and case-insensitive repeats, first spelling kept."""
    return _document_needs(spark, sf_dir)


@query(
    "search_terms",
    f"""WITH needs AS ({_NEED_SQL}) SELECT pos, need, t.term_pos, replace(t.template, '{{need}}', need) AS term
    FROM needs, (VALUES {', '.join(f'({i}, {q.lit(t)})' for i, t in enumerate(SEARCH_TEMPLATES))}) AS t(term_pos, template)""",
)
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template filled with every need."""
    return need_source.search_terms(_document_needs(spark, sf_dir), SEARCH_TEMPLATES)


# --- saved pages -------------------------------------------------------------------

_HEADS = (
    '<meta property="og:title" content="Wrong title"><meta property="og:description" content="Paul McCarron on LinkedIn: We need help &amp; advice N">'
    r'<script type="application/ld+json">{"@type":"Post","text":"a \"datePublished\":\"2020-02-02\" in words","inner":[{"datePublished":"soon"},'
    r'{"a":[[{"b":{"date\u0050ublished":"2024\u002d01-1DT14:22:00.000Z"}}]]},{"datePublished":"2021-01-01"}]}</script>',
    "<meta content='Looking for an agency N' name='og:title'/>",
    "",
    '<meta property="og:title" content="Sign Up | LinkedIn">',
    '<meta name="og:description" content="Plain text of post N > all">',
    '<meta property="og:description" content="  "><meta property="og:title" content="Title N">',
    "",
    '<meta property="og:description" content="A long sentence with many more words than names on LinkedIn - Body N">'
    '<script type="application/ld+json">{"datePublished": broken}</script>',
)
_BODIES = (
    '<a href="/jobs">x</a><a class="p" href="https://www.linkedin.com/in/paul-N?trk=1">Paul</a>',
    '<time class="t" datetime="2024-01-1DT09:30:00Z">x</time>',
    "",
    "",
    '<p class="author-headline">Founder at Acme &amp; Co</p><time datetime="2024-01-1D">x</time>',
    '<span data-test-id="author-headline" class="x"> CEO </span><a href="/in/b-N">b</a>',
    "",
    '<a href="//uk.linkedin.com/in/c-N">c</a><time datetime="yesterday">x</time><time datetime="2024-01-01">y</time>',
)
_PAGE_URLS = (
    "https://www.linkedin.com/posts/somebody-else_N",
    "https://www.linkedin.com/posts/jane-doe-8aa_N",
    "https://www.linkedin.com/posts/ravi-kumar_N",
    "https://www.linkedin.com/posts/wall-page_N",
    "https://www.linkedin.com/posts/lena-k-77_N?x=1",
    "https://www.linkedin.com/posts/omar_N",
    "https://www.linkedin.com/feed/update/N",
    "https://www.linkedin.com/posts/tom-payne_N",
)


def _numbered(values: tuple[str, ...]) -> F.Column:
    text = F.replace(choose(values, "page_id"), F.lit("1DT"), F.concat((F.col("page_id") % 10 + 10).cast("string"), F.lit("T")))
    text = F.replace(text, F.lit('1D"'), F.concat((F.col("page_id") % 10 + 10).cast("string"), F.lit('"')))
    return F.regexp_replace(text, r"\bN\b", F.col("page_id").cast("string"))


def post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with post markup added in head and article."""
    p = spread(table(spark, sf_dir, "pages"), "page_id")
    head = F.concat(_numbered(_HEADS), F.lit("<title>"))
    body = F.concat(F.lit("<article>"), _numbered(_BODIES))
    page = F.replace(F.replace(F.col("html"), F.lit("<title>"), head), F.lit("<article>"), body)
    return p.select("page_id", _numbered(_PAGE_URLS).alias("url"), page.alias("html"))


def _numbered_sql(values: tuple[str, ...]) -> str:
    text = f"replace({q.pick(values, 'page_id')}, '1DT', (page_id % 10 + 10) || 'T')"
    text = f"replace({text}, '1D\"', (page_id % 10 + 10) || '\"')"
    return rf"regexp_replace({text}, '\bN\b', page_id::VARCHAR, 'g')"


_PAGES_SQL = (
    "post_pages",
    f"""SELECT page_id, page_id % 8 AS kind, {_numbered_sql(_PAGE_URLS)} AS url,
      replace(replace(html, '<title>', {_numbered_sql(_HEADS)} || '<title>'), '<article>', '<article>' || {_numbered_sql(_BODIES)}) AS html FROM pages""",
)


def _decoded_sql(text: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{entity}', {q.lit(char)})"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


_META = r"""nullif(trim({decoded}), '')"""


def _meta_sql(key: str) -> str:
    by_property = f"""regexp_extract(html, '<meta property="{key}" content="([^"]*)"', 1)"""
    by_name = f"""regexp_extract(html, '<meta name="{key}" content="([^"]*)"', 1)"""
    reversed_name = f"""regexp_extract(html, '<meta content=''([^'']*)'' name=''{key}''', 1)"""
    found = f"""CASE WHEN contains(html, '<meta property="{key}"') THEN {by_property} ELSE coalesce(nullif({by_name}, ''), {reversed_name}) END"""
    return _META.format(decoded=_decoded_sql(found))


_ARTICLE = f"""nullif({_decoded_sql(q.collapse("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*>', ' ', 'g')"))}, '')"""
_READ_SQL = (
    "read",
    f"""SELECT page_id, url, html, {_meta_sql('og:title')} AS og_title, {_meta_sql('og:description')} AS og_description,
      {_decoded_sql(q.collapse("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title, {_ARTICLE} AS body,
      regexp_extract(html, '<a [^>]*href="((?:https:|//|/in/)[^"]*/in/[^"]*|/in/[^"]*)"', 1) AS profile,
      coalesce(nullif(regexp_extract(replace(replace(html, '\\u0050', 'P'), '\\u002d', '-'), '"datePublished":"(20[^"]*)"', 1), ''), regexp_extract(html, '<time[^>]* datetime="([^"]*)"', 1)) AS stamp,
      {_decoded_sql(r"trim(coalesce(nullif(regexp_extract(html, '<p class=.author-headline.>([^<]*)</p>', 1), ''), regexp_extract(html, '<span data-test-id=.author-headline. class=.x.>([^<]*)</span>', 1)))")} AS headline
      FROM post_pages""",
)
_PARSED_SQL = (
    "parsed",
    r"""SELECT *, nullif(trim(regexp_extract(og_description, '^(.*?)\s+on\s+LinkedIn(?:[^\p{L}\p{N}_]|$)', 1)), '') AS desc_name,
      nullif(trim(regexp_replace(regexp_extract(og_description, '\s+on\s+LinkedIn((?:[^\p{L}\p{N}_]|$).*)$', 1), '^[ :–—-]+', '')), '') AS desc_body,
      regexp_matches(lower(concat_ws(' ', title, og_title, og_description)), 'sign up \| linkedin|500 million\+ members|manage your professional identity|join linkedin to|agree & join linkedin') AS wall,
      nullif(array_to_string(list_transform(string_split(regexp_replace(regexp_extract(url, '/posts/([^/?#_]*)', 1),
        '(?:(?:^|-)[^-]*[0-9][^-]*)+$', ''), '-'), lambda x: upper(x[1]) || lower(x[2:])), ' '), '') AS slug_name FROM read""",
)
_FINAL_SQL = (
    "final",
    """SELECT page_id, url, CASE WHEN length(desc_name) <= 60 AND length(desc_name) - length(replace(desc_name, ' ', '')) <= 6
        THEN desc_name ELSE slug_name END AS author_name,
      coalesce(desc_body, og_description, og_title, body) AS post_text, nullif(headline, '') AS author_headline,
      CASE WHEN profile LIKE '//%' THEN 'https:' || profile WHEN profile LIKE '/%' THEN 'https://www.linkedin.com' || profile
        WHEN profile LIKE 'http%' THEN split_part(profile, '?', 1) END AS author_profile_url,
      try_cast(replace(stamp, 'Z', '') AS TIMESTAMP) AS posted_at, wall FROM parsed""",
)
_OUTCOME_SQL = (
    "outcomes",
    """SELECT *, CASE WHEN wall THEN 'blocked' WHEN author_name IS NULL OR post_text IS NULL THEN 'parse_error' ELSE 'ok' END AS outcome FROM final""",
)
PAGE_SQL = (_PAGES_SQL, _READ_SQL, _PARSED_SQL, _FINAL_SQL, _OUTCOME_SQL)


@query(
    "page_extraction",
    f"""{q.with_ctes(*PAGE_SQL)} SELECT page_id, url, outcome, {', '.join(f"CASE WHEN outcome = 'ok' THEN {c} END AS {c}" for c in ('author_name', 'author_headline', 'author_profile_url'))},
      CASE WHEN outcome = 'ok' THEN {q.collapse('post_text')} END AS post_text,
      CASE WHEN outcome = 'ok' THEN epoch_us(posted_at) END AS posted FROM outcomes""",
)
def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages to typed posts with an outcome."""
    from needwell.functions.text import collapse_whitespace

    parsed = parse_pages(post_pages(spark, sf_dir), PLATFORM)
    return parsed.select(
        "page_id",
        "url",
        "outcome",
        "author_name",
        "author_headline",
        "author_profile_url",
        collapse_whitespace(F.col("post_text")).alias("post_text"),
        F.unix_micros("posted_at").alias("posted"),
    )


@query(
    "page_outcomes",
    f"{q.with_ctes(*PAGE_SQL)} SELECT outcome, count(*) AS pages FROM outcomes GROUP BY outcome",
)
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per outcome."""
    parsed = parse_pages(post_pages(spark, sf_dir), PLATFORM)
    return parsed.groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "page_titles",
    f"""{q.with_ctes(*PAGE_SQL[:2])} SELECT page_id, {_decoded_sql(q.collapse("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
      length(body)::BIGINT AS body_length, og_title FROM read""",
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, meta title and length of the visible article text of each page."""
    p = post_pages(spark, sf_dir).withColumn("m", h.meta_tags(F.col("html")))
    return p.select(
        "page_id",
        h.decode_entities(h.page_title(F.col("html"))).alias("title"),
        F.char_length(h.decode_entities(h.main_text(F.col("html")))).cast("bigint").alias("body_length"),
        h.decode_entities(h.meta_content(F.col("m"), "og:title")).alias("og_title"),
    )
