"""Text, name and contact functions over whole documents and derived posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.functions import contact, dates, text
from needwell.operators import rules
from workload import dialect as q
from workload.registry import query, table
from workload.views import FOLDED_SQL, POSTS_SQL, choose, posts

# --- cleaning ---------------------------------------------------------------

EMOJI_SQL = q.lit(text.EMOJI_CLASS)


def _control_sql() -> str:
    return f"SELECT doc_id, {q.collapse('chr(9) || text || chr(7) || chr(160) || chr(10)')} AS tidy FROM documents"


@query("text_tidy", _control_sql())
def text_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters and white space over whole document texts."""
    docs = table(spark, sf_dir, "documents")
    noisy = F.concat(F.lit("\t"), F.col("text"), F.lit("\x07\xa0\n"))
    tidy = text.collapse_whitespace(text.strip_control_chars(noisy))
    return docs.select("doc_id", tidy.alias("tidy"))


@query(
    "text_emoji",
    f"""{q.with_ctes(POSTS_SQL)}
    SELECT seq, regexp_replace(author_name || '\U0001f680' || post_text, {EMOJI_SQL}, '', 'g') AS plain FROM posts""",
)
def text_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictographs stripped."""
    joined = F.concat("author_name", F.lit("\U0001f680"), "post_text")
    return posts(spark, sf_dir).select("seq", text.strip_emoji(joined).alias("plain"))


@query(
    "text_folded",
    f"""{q.with_ctes(FOLDED_SQL)}
    SELECT seq, post_text AS folded, post_text AS nfkc_of_decoded FROM folded""",
)
def text_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities decoded and NFKC applied, in one pass and in two."""
    p = posts(spark, sf_dir)
    two_steps = text.normalize_unicode(text.decode_entities(F.col("post_text")))
    return p.select(
        "seq", text.fold_text(F.col("post_text")).alias("folded"), two_steps.alias("nfkc_of_decoded")
    )


@query(
    "text_clean",
    f"""{q.with_ctes(FOLDED_SQL)}
    SELECT seq, {q.collapse('post_text')} AS clean FROM folded""",
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full cleaning chain over whole posts."""
    return posts(spark, sf_dir).select("seq", text.clean_text(F.col("post_text")).alias("clean"))


def name_sql(column: str) -> str:
    """A cleaned author name from a folded one."""
    name = q.collapse(f"regexp_replace({q.collapse(column)}, {EMOJI_SQL}, '', 'g')")
    return rf"regexp_replace({name}, '^(\S+(?: \S+)*?)(?: \S*\p{{Nd}}\S*)+$', '\1')"


def doubtful_sql(name: str) -> str:
    return (
        rf"({name} = '' OR regexp_matches({name}, '\p{{Nd}}') "
        rf"OR (NOT contains({name}, ' ') AND length({name}) >= 12))"
    )


@query(
    "author_names",
    f"""{q.with_ctes(FOLDED_SQL, ('named', f"SELECT seq, {name_sql('author_name')} AS name FROM folded"))}
    SELECT seq, name, {doubtful_sql('name')} AS low_confidence FROM named""",
)
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned author names and whether to trust them."""
    p = posts(spark, sf_dir).withColumn("n", text.clean_author_name(F.col("author_name")))
    return p.select("seq", F.col("n.value").alias("name"), F.col("n.low_confidence"))


def headline_company_sql(column: str) -> str:
    pattern = rf"(?i)(?:(?:^|[^{q.WORD}])at|@)\s+(.+?)\s*$"
    return f"nullif({q.strip(f'regexp_extract({column}, {q.lit(pattern)}, 1)')}, '')"


@query(
    "headline_companies",
    f"""{q.with_ctes(POSTS_SQL)}
    SELECT seq, nullif({q.strip('author_headline')}, '') AS headline,
           {headline_company_sql('author_headline')} AS company FROM posts""",
)
def headline_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company named after ``at`` or ``@``; blank headlines are NULL."""
    h = F.col("author_headline")
    return posts(spark, sf_dir).select(
        "seq", text.blank_to_null(h).alias("headline"), text.company_from_headline(h).alias("company")
    )


@query("need_excerpts", "SELECT doc_id, substr(text, 1, 500) AS excerpt, length(text) AS full_length FROM documents")
def need_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt operator: first characters of a post, counted in code points."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        text.need_excerpt(F.col("text")).alias("excerpt"),
        F.char_length("text").cast("bigint").alias("full_length"),
    )


def tokens_sql(need: str) -> str:
    """Content tokens of a need."""
    words = f"regexp_extract_all(lower({need}), '[a-z0-9]+')"
    stop = "['a','an','the','for','of','and','to','in']"
    content = f"list_filter({words}, lambda w: NOT list_contains({stop}, w))"
    return f"CASE WHEN len({content}) > 0 THEN {content} ELSE {words} END"


@query(
    "need_tokens",
    f"""WITH needs AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'The in-house of ' || source
               WHEN doc_id % 4 = 1 THEN 'of the' WHEN doc_id % 4 = 2 THEN '' ELSE text END AS need FROM documents)
    SELECT doc_id, array_to_string({tokens_sql('need')}, ' ') AS tokens FROM needs""",
)
def need_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content tokens of phrases, among them whole texts and pure stop words."""
    d = F.col("doc_id")
    need = (
        F.when(d % 4 == 0, F.concat(F.lit("The in-house of "), "source"))
        .when(d % 4 == 1, "of the")
        .when(d % 4 == 2, "")
        .otherwise(F.col("text"))
    )
    docs = table(spark, sf_dir, "documents").withColumn("need", need)
    return docs.select("doc_id", F.array_join(text.content_tokens(F.col("need")), " ").alias("tokens"))


BYLINES = (
    "Ann Lee on LinkedIn: ",
    "  Ann   Lee   ON linkedin – ",
    "A very long sentence that goes on and on and on and has far too many words to be a name on LinkedIn: ",
    "Ann Lee on LinkedInX: ",
    " on LinkedIn: ",
    "No byline here, ",
)


@query(
    "named_bodies",
    rf"""WITH t AS (SELECT doc_id, {q.pick(BYLINES, 'doc_id')} || text AS line FROM documents),
    s AS (SELECT doc_id,
      nullif({q.strip(r"regexp_extract(line, '(?is)^(.*?)\s+on\s+LinkedIn(?:$|[^\p{L}\p{N}_])', 1)")}, '') AS name,
      nullif({q.strip(r"regexp_replace(regexp_extract(line, '(?is)\s+on\s+LinkedIn((?:$|[^\p{L}\p{N}_]).*)$', 1), '^[ :–—-]+', '')")}, '') AS body
      FROM t)
    SELECT doc_id, name, body,
      length(name) BETWEEN 1 AND 60 AND length(name) - length(replace(name, ' ', '')) <= 6 AS plausible FROM s""",
)
def named_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<name> on <platform>: <body>`` split, with the plausible-name test."""
    line = F.concat(choose(BYLINES, "doc_id"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.split_named_body(line, "LinkedIn").alias("s"))
    return docs.select(
        "doc_id",
        F.col("s.name").alias("name"),
        F.col("s.body").alias("body"),
        text.plausible_name(F.col("s.name")).alias("plausible"),
    )


# --- contact facts ----------------------------------------------------------

EMAIL_SQL = q.lit(contact.EMAIL_TOKEN)


@query(
    "document_emails",
    f"SELECT doc_id, nullif(lower(regexp_extract(text, {EMAIL_SQL}, 0)), '') AS email FROM documents",
)
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First address in each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", contact.first_email(F.col("text")).alias("email"))


EMAIL_FORMS = (" User{n}@Example.COM ", "missing-at{n}.com", "a@b", "x @y.co", "n{n}@mail.example.org", "")


@query(
    "customer_emails",
    rf"""WITH c AS (SELECT c_custkey,
      replace({q.pick(EMAIL_FORMS, 'c_custkey')}, '{{n}}', c_custkey::VARCHAR) AS raw FROM customer),
    n AS (SELECT c_custkey, lower({q.strip('raw')}) AS e FROM c)
    SELECT c_custkey, CASE WHEN regexp_matches(e, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN e END AS email FROM n""",
)
def customer_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address normalisation over every customer."""
    raw = F.replace(choose(EMAIL_FORMS, "c_custkey"), F.lit("{n}"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", contact.normalize_email(raw).alias("email"))


SITES = (
    "see https://www.Site{n}.example/Path/?utm_source=a&id={n}#top, ",
    "at (www.site{n}.example) ",
    "bare site{n}.example only ",
    "broken http://?x then HTTPS://Ok.example/a?REF=1&b=2. ",
    "",
)


def normalize_sql(url: str) -> str:
    """Normalised http(s) URL of a trimmed URL expression."""
    parts = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
    scheme, host, path = (f"regexp_extract({url}, {q.lit(parts)}, {i})" for i in (1, 2, 3))
    query_part = rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"
    name = "url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' '))"
    value = "url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))"
    tracked = "'^(utm_|fbclid|gclid|mc_|ref|trk|originaltrk)'"
    kept = f"""array_to_string(list_transform(
        list_filter(string_split({query_part}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower({name}), {tracked})),
        lambda p: replace(url_encode({name}), '%20', '+') || '=' || replace(url_encode({value}), '%20', '+')), '&')"""
    return f"""CASE WHEN regexp_matches({url}, '(?i)^https?://[^/?#]+') THEN
        lower({scheme}) || '://' || lower({host}) || {path}
        || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"""


def website_sql(text_column: str) -> str:
    """First explicit URL of a text, normalised."""
    token = r"(?i)(?:https?://|www\.)[^\s<>()\[\]{}\"']+"
    trimmed = "rtrim(t, '.,);:]}\"''')"
    absolute = f"CASE WHEN lower({trimmed}) LIKE 'http%' THEN {trimmed} ELSE 'https://' || {trimmed} END"
    return f"""(list_filter(list_transform(list_transform(
        regexp_extract_all({text_column}, {q.lit(token)}), lambda t: {absolute}),
        lambda u: {normalize_sql('u')}), lambda w: w IS NOT NULL))[1]"""


@query(
    "document_websites",
    f"""WITH d AS (SELECT doc_id,
        replace({q.pick(SITES, 'doc_id')}, '{{n}}', doc_id::VARCHAR) || text AS t0 FROM documents)
    SELECT doc_id, {website_sql('t0')} AS website FROM d""",
)
def document_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First explicit URL in each text."""
    lead = F.replace(choose(SITES, "doc_id"), F.lit("{n}"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", contact.first_website(F.concat(lead, "text")).alias("website"))


PHONES = ("(415) 555-{n}", "+91 98765 1{n}", "+44 20 7946 {n}", "12", "abc", "+1-212-555-{n}", "1 415 555 {n}", "+999 1{n}", "")


@query(
    "customer_phones",
    rf"""WITH c AS (SELECT c_custkey,
      replace({q.pick(PHONES, 'c_custkey')}, '{{n}}', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS raw FROM customer),
    d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM c)
    SELECT c_custkey, CASE WHEN NOT regexp_matches(raw, '^\+?[0-9()\s./\-]+$') THEN NULL
      WHEN raw LIKE '+%' THEN CASE WHEN regexp_matches(digits,
        '^(?:1[2-9]\d{{2}}[2-9]\d{{6}}|91[1-9]\d{{9}}|44[1-9]\d{{8,9}}|49[1-9]\d{{5,12}}|33[1-9]\d{{8}}|34[5-9]\d{{8}}|61[1-9]\d{{8}}|65[3689]\d{{7}})$')
        THEN '+' || digits END
      WHEN regexp_matches(digits, '^1?[2-9]\d{{2}}[2-9]\d{{6}}$') THEN '+1' || right(digits, 10) END AS phone,
      CASE WHEN raw = '' THEN NULL WHEN phone IS NOT NULL THEN 'ok'
        WHEN regexp_matches(raw, '^\+[0-9()\s./\-]+$') AND NOT regexp_matches(digits, '^(?:1|91|44|49|33|34|61|65)') THEN 'no_rule'
        ELSE 'invalid' END AS state FROM d""",
)
def customer_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers to E.164 over every customer."""
    tail = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    raw = F.replace(choose(PHONES, "c_custkey"), F.lit("{n}"), tail)
    rows = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    read = rules.with_phone(rows, "raw", rules.default_dialling(spark), out="phone")
    return read.select("c_custkey", "phone", F.col("phone_state").alias("state"))


COMPANY_LEADS = (
    "Unity Search Ltd. is looking for help. ",
    "Hi all, we're Nordlicht & Sons. We need help. ",
    "We Are Hiring. We are Acme Works Intl. and friends. ",
    "Our Client is hiring. We are Oak-Lab now. ",
    "nobody is seeking anything. ",
    "The Team is seeking help. ",
)


def post_company_sql(text_column: str) -> str:
    """Company named in a post."""
    word = r"[A-Z][A-Za-z0-9&.\-]*"
    name = rf"{word}(?:\s+{word}){{0,4}}"
    last = r"[A-Z](?:[A-Za-z0-9&.\-]*[A-Za-z0-9])?"
    closed = rf"(?:{word}\s+){{0,4}}{last}"
    subject = rf"{q.START}({name})\s+is\s+(?:looking|hiring|seeking){q.END}"
    selfid = rf"{q.START}[Ww]e(?:'re| are)\s+({closed}){q.END}"
    stops = ", ".join(q.lit(w) for w in contact.NOT_A_COMPANY)

    def checked(pattern: str) -> str:
        hit = f"regexp_extract({text_column}, {q.lit(pattern)}, 1)"
        first = rf"lower(regexp_extract({hit}, '^(\S+)', 1))"
        return f"CASE WHEN {hit} <> '' AND {first} NOT IN ({stops}) THEN {hit} END"

    return f"coalesce({checked(subject)}, {checked(selfid)})"


@query(
    "post_companies",
    f"""WITH d AS (SELECT doc_id, {q.pick(COMPANY_LEADS, 'doc_id')} || text AS t0,
        CASE WHEN doc_id % 2 = 0 THEN 'Founder at ' || source END AS headline FROM documents)
    SELECT doc_id, {post_company_sql('t0')} AS from_post,
        coalesce({post_company_sql('t0')}, {headline_company_sql('headline')}) AS company FROM d""",
)
def post_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company stated in the post, else in the headline."""
    t = F.concat(choose(COMPANY_LEADS, "doc_id"), "text")
    headline = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Founder at "), "source"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        contact.company_from_post(t).alias("from_post"),
        contact.company_name(t, headline).alias("company"),
    )


@query(
    "post_facts",
    f"""{q.with_ctes(FOLDED_SQL, ('clean', f'SELECT seq, {q.collapse("post_text")} AS t, {q.collapse("author_headline")} AS h FROM folded'))}
    SELECT seq, coalesce({post_company_sql('t')}, {headline_company_sql('h')}) AS company,
        nullif(lower(regexp_extract(t, {EMAIL_SQL}, 0)), '') AS contact_email,
        {website_sql('t')} AS website FROM clean""",
)
def post_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three enrichment facts of every cleaned post."""
    clean = posts(spark, sf_dir).select(
        "seq", text.clean_text(F.col("post_text")).alias("t"), text.clean_text(F.col("author_headline")).alias("h")
    )
    return clean.select("seq", contact.enrichment(F.col("t"), F.col("h")).alias("e")).select("seq", "e.*")


# --- dates ------------------------------------------------------------------

DATE_FORMS = (
    "2024-02-{d}T09:30:00Z",
    "2024-02-{d}",
    "2024-02-{d}T09:30:00.250+05:30",
    "2024-02-{d} 09:30",
    "2024-13-{d}",
    "soon",
    "",
    " 2024-03-{d}T01:02:03-02:00 ",
)


@query(
    "iso_dates",
    rf"""WITH e AS (SELECT event_id, {q.strip(f"replace({q.pick(DATE_FORMS, 'event_id')}, '{{d}}', lpad((event_id % 28 + 1)::VARCHAR, 2, '0'))")} AS v FROM events)
    SELECT event_id, epoch_us(CASE
        WHEN regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}.*)?$') THEN
          CASE WHEN regexp_matches(v, '(Z|[+\-]\d{{2}}:\d{{2}})$') THEN try_cast(v AS TIMESTAMPTZ)::TIMESTAMP
          ELSE try_cast(CASE WHEN length(v) = 16 THEN v || ':00' ELSE v END AS TIMESTAMP) END END) AS micros FROM e""",
)
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps read from text; naive ones are UTC, unreadable ones NULL."""
    day = F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0")
    raw = F.replace(choose(DATE_FORMS, "event_id"), F.lit("{d}"), day)
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(dates.parse_iso(raw)).alias("micros"))


@query(
    "recency_windows",
    r"""WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE
        ' ' || (event_id % 60) || ['d','W','m','Y'][(event_id % 4 + 1)::BIGINT] END AS since FROM events),
    p AS (SELECT *, try_cast(regexp_extract(since, '^\s*(\d+)', 1) AS BIGINT) *
        CASE lower(right(since, 1)) WHEN 'd' THEN 1 WHEN 'w' THEN 7 WHEN 'm' THEN 30 WHEN 'y' THEN 365 END AS days FROM e)
    SELECT event_id, days, CASE WHEN days <= 1 THEN 'd' WHEN days <= 7 THEN 'w' WHEN days <= 31 THEN 'm'
        WHEN days IS NOT NULL THEN 'y' END AS bucket FROM p""",
)
def recency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows such as ``7d`` to days and buckets."""
    e = F.col("event_id")
    since = F.when(e % 11 == 0, "soon").otherwise(
        F.concat(F.lit(" "), (e % 60).cast("string"), choose(("d", "W", "m", "Y"), "event_id"))
    )
    events = table(spark, sf_dir, "events").select("event_id", since.alias("since"))
    return events.select(
        "event_id",
        dates.recency_days(F.col("since")).alias("days"),
        dates.recency_bucket(F.col("since")).alias("bucket"),
    )


@query(
    "utc_days",
    """SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start,
        ts >= TIMESTAMP '2024-01-31' - to_days((event_id % 40)::INTEGER) AS recent FROM events""",
)
def utc_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC day starts and an age cutoff per row."""
    ts = F.col("ts").cast("timestamp")
    cutoff = dates.age_cutoff(dates.clock("2024-01-31T00:00:00Z"), (F.col("event_id") % 40).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format(dates.utc_day_start(ts), "yyyy-MM-dd HH:mm:ss").alias("day_start"),
        (ts >= cutoff).alias("recent"),
    )
