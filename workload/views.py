"""Posts, leads, attempts and pages derived from the given tables.

The given texts hold no asks and no links, so each document is put behind one
template sentence, author, headline and need. Every row and every text is used
whole; where the sentence is blank, there is one more post of that sentence
alone. The same derivation exists as SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.config import NEEDS, Platform
from needwell.functions.dates import clock
from workload.dialect import folded, lit, pick
from needwell.session import spread
from workload.registry import table

NOW = "2024-01-31T00:00:00Z"
FIRST_SEEN = "2024-01-30T00:00:00Z"
PLATFORM = Platform()

TEMPLATES = (
    "We are looking for a marketing agency to grow our bakery.",
    "Need a freelancer for our launch. Please email me: Owner@Bakery-Shop.example today.",
    "We&#39;re hiring a full-time social media manager, apply now.",
    "New role at our firm, salary and benefits package included.",
    "Come join us and our roster of SEO experts.",
    "I am seeking designers on a freelance basis for our talent pool.",
    "Why hire an SEO agency? Top 5 reasons inside.",
    "How to choose a vendor with the right web design agency budget.",
    "Hot take: this article on a branding agency is worth reading.",
    "My journey so far. In 2022 I sat down reflecting on a website developer.",
    "Great weather in town today.",
    "Our office moved &amp; tea is good, see www.Quiet-Office.example/News?utm_source=x&id=7&lang=en.",
    "",
    "  \t ",
    "&nbsp; &nbsp;",
    "Bright Oak Studio is looking for a PPC agency. \U0001d40b\U0001d428\U0001d428\U0001d424 here, we need help \U0001f680 soon.",
)
BLANK = tuple(i for i, sentence in enumerate(TEMPLATES) if not sentence.replace("&nbsp;", "").strip())
AUTHORS = (
    "Maria Keller",
    "Aiden Novak 8aa8977",
    "Lena Brandt 79785053",
    "Tomasrodriguez",
    "Bluewave Marketing Agency",
    "   ",
    "\U0001f680\U0001f680",
    "\U0001d412\U0001d41a\U0001d42b\U0001d41a\U0001d421 Lind \U0001f31f",
    "Priya &amp; Ravi",
    "7731aa",
    "Omar Haddad",
    "Pixel Media 12 b7",
)
HEADLINES = (
    None,
    "Founder at Acme Studios",
    "CEO @ Globex",
    "Marketing lead",
    " Owner &amp; Baker at Bread &amp; Co ",
    "",
    "Working from home at Oak Labs ",
    "Chat with me",
    "Partner AT Nord Digital",
)
PROFILES = (None, "https://social.example/in/maria", "not-a-url", "", " HTTP://Social.Example/in/x ")


def _spark_lit(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def choose(values: Sequence[str | None], index: str) -> Column:
    """The element of a constant list that a zero-based index column selects."""
    constants = ", ".join(_spark_lit(v) for v in values)
    return F.expr(f"element_at(array({constants}), CAST(pmod({index}, {len(values)}) + 1 AS INT))")


def now() -> Column:
    return clock(NOW)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat derived posts: one per document, and one more per blank sentence."""
    given = spread(table(spark, sf_dir, "documents"), "doc_id")
    d, blank = F.col("doc_id"), F.col("blank")
    copies = F.when((d % len(TEMPLATES)).isin(*BLANK), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    docs = given.select("*", F.explode(copies).alias("blank"))
    sentence = choose(TEMPLATES, "doc_id")
    key = F.when(d % 10 == 9, d - 9).otherwise(d)
    posted = (
        F.timestamp_seconds(F.lit(1706745600))  # 2024-02-01
        - F.make_dt_interval(days=(d % 45).cast("int"), hours=(F.col("n_chars") % 24).cast("int"))
    )
    return docs.select(
        F.when(blank, -d - 1).otherwise(d).alias("seq"),
        F.col("source"),
        choose(AUTHORS, "doc_id").alias("author_name"),
        choose(HEADLINES, "doc_id").alias("author_headline"),
        choose(PROFILES, "doc_id").alias("author_profile_url"),
        F.when(blank, sentence).otherwise(F.concat(sentence, F.lit(" "), F.col("text"))).alias("post_text"),
        F.when(d % 7 != 0, posted).alias("posted_at"),
        choose(NEEDS, "doc_id").alias("need"),
        F.when(blank, F.concat(F.lit("https://social.example/posts/blank-1_"), d.cast("string")))
        .otherwise(
            F.concat(F.lit("https://social.example/posts/user-"), (key % 7).cast("string"), F.lit("_"), key.cast("string"))
        )
        .alias("post_url"),
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived posts in the raw input layout."""
    data = F.struct("author_name", "author_headline", "author_profile_url", "post_text", "posted_at")
    return posts(spark, sf_dir).select(
        "source",
        F.col("post_url").alias("source_url"),
        clock(FIRST_SEEN).alias("fetched_at"),
        "need",
        "seq",
        data.alias("data"),
    )


def _posts_body(sentences: Sequence[str], authors: Sequence[str], headlines: Sequence[str | None]) -> str:
    text = pick(sentences, "doc_id")
    return f"""
  SELECT CASE WHEN blank THEN -doc_id - 1 ELSE doc_id END AS seq, source,
         {pick(authors, 'doc_id')} AS author_name,
         {pick(headlines, 'doc_id')} AS author_headline,
         {pick(PROFILES, 'doc_id')} AS author_profile_url,
         CASE WHEN blank THEN {text} ELSE {text} || ' ' || text END AS post_text,
         {text} AS sentence, NOT blank AS follows, text AS doc_text,
         CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-02-01' - to_days((doc_id % 45)::INTEGER)
              - to_hours(n_chars % 24) END AS posted_at,
         {pick(NEEDS, 'doc_id')} AS need,
         CASE WHEN blank THEN 'https://social.example/posts/blank-1_' || doc_id ELSE
         'https://social.example/posts/user-' || ((CASE WHEN doc_id % 10 = 9 THEN doc_id - 9 ELSE doc_id END) % 7)
           || '_' || (CASE WHEN doc_id % 10 = 9 THEN doc_id - 9 ELSE doc_id END) END AS post_url,
         {pick(TEMPLATES, 'doc_id')} AS raw_sentence
  FROM (SELECT *, false AS blank FROM documents
        UNION ALL SELECT *, true FROM documents WHERE doc_id % {len(TEMPLATES)} IN {BLANK}) AS given"""


# raw values as they arrive
POSTS_SQL = ("posts", _posts_body(TEMPLATES, AUTHORS, HEADLINES))
# the same rows with entities and styled letters of the constants already folded
FOLDED_SQL = (
    "folded",
    _posts_body([folded(s) for s in TEMPLATES], [folded(a) for a in AUTHORS], [folded(h) for h in HEADLINES]),
)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
FIRST_SEEN_SQL = "TIMESTAMP '2024-01-30 00:00:00'"


def ts_text(name: str) -> Column:
    """A timestamp as text, so that no client time zone plays a part."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def ts_text_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


__all__ = ["lit"]
