"""Reading public post pages with regular expressions, no DOM.

Markup outside the expected shapes yields NULL and ends as ``parse_error``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from needwell.config import Platform
from needwell.functions.dates import parse_iso
from needwell.functions.text import (
    blank_to_null,
    collapse_whitespace,
    decode_entities,
    plausible_name,
    split_named_body,
)
from needwell.functions.urls import absolute_profile_url, author_from_slug

OK, BLOCKED, PARSE_ERROR = "ok", "blocked", "parse_error"

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b{_ATTRS}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Raw value of an attribute inside one tag; '' when absent."""
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    groups = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    return F.concat(*groups)


def without_comments(html: Column) -> Column:
    """Comments removed; one that never ends takes the rest of the page."""
    return F.when(
        F.contains(html, F.lit("<!--")), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    ).otherwise(html)


def meta_tags(html: Column) -> Column:
    """Every ``<meta>`` tag of a page, in order."""
    return _tags(html, "meta")


def meta_content(metas: Column, key: str) -> Column:
    """Content by ``property``, then by ``name``; still entity-encoded, blank is NULL."""
    first = F.coalesce(
        F.try_element_at(F.filter(metas, lambda m: attribute(m, "property") == key), F.lit(1)),
        F.try_element_at(F.filter(metas, lambda m: attribute(m, "name") == key), F.lit(1)),
    )
    return blank_to_null(attribute(first, "content"))


def visible_text(fragment: Column) -> Column:
    """Text of a fragment: scripts and tags dropped, one space between pieces."""
    no_code = F.regexp_replace(fragment, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    return collapse_whitespace(F.regexp_replace(no_code, rf"(?s)</?[A-Za-z]{_ATTRS}>", " "))


def page_title(html: Column) -> Column:
    """Text of the ``<title>`` element, still entity-encoded."""
    return collapse_whitespace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def _element(html: Column, name: str) -> Column:
    """What the first element of a name holds, up to its own end tag or the end of the page.

    Start and end tags cut the page into pieces; a running depth finds the tags between which the element lies,
    and its pieces are joined once.
    """
    tag = rf"(?is)</?{name}\b{_ATTRS}>"
    steps = F.transform(
        F.regexp_extract_all(html, F.lit(tag), F.lit(0)),
        lambda t, i: F.struct(F.when(t.startswith("</"), -1).otherwise(1).alias("step"), i.alias("at")),
    )
    before = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("opened"), F.lit(-1).alias("closed"))

    def follow(s: Column, x: Column) -> Column:
        depth = s["depth"] + x["step"]
        opened = F.when(s["opened"] < 0, x["at"]).otherwise(s["opened"])
        closed = F.when(depth == 0, x["at"]).otherwise(F.lit(-1))
        moved = F.struct(depth.alias("depth"), opened.alias("opened"), closed.alias("closed"))
        return F.when((s["closed"] >= 0) | (depth < 0), s).otherwise(moved)

    def inside(s: Column) -> Column:
        count = F.when(s["closed"] >= 0, s["closed"]).otherwise(F.size(steps)) - s["opened"]
        pieces = F.slice(F.split(html, tag, -1), s["opened"] + 2, count)
        return F.when(s["opened"] >= 0, F.array_join(pieces, " ")).otherwise("")

    return F.aggregate(steps, before, follow, inside)


def main_text(html: Column) -> Column:
    """Text of the first ``<article>``, else ``<main>``; NULL when neither holds text."""

    def element(name: str) -> Column:
        found = html.rlike(rf"(?i)<{name}\b")
        return F.when(found, visible_text(_element(html, name)))

    return F.nullif(F.coalesce(element("article"), element("main")), F.lit(""))


def is_wall(title: Column, og_title: Column, og_description: Column, platform: Platform) -> Column:
    """The page is a sign-up wall instead of a post."""
    haystack = F.lower(F.concat_ws(" ", title, og_title, og_description))
    hit = F.lit(False)
    for marker in platform.wall_markers:
        hit = hit | F.contains(haystack, F.lit(marker))
    return hit


def author_headline(html: Column) -> Column:
    """Text of the headline element, found by class or data attribute."""
    named = r"class\s*=\s*[\"'](?:[^\"']*\s)?author-headline(?:\s[^\"']*)?[\"']"
    tested = r"data-test-id\s*=\s*[\"']author-headline[\"']"
    pattern = rf"(?is)<(\w+)\b[^>]*\s(?:{named}|{tested})[^>]*>(.*?)</\1\s*>"
    text = F.regexp_replace(F.regexp_extract(html, pattern, 2), r"(?s)<[^>]*>", "")
    return F.when(F.contains(html, F.lit("author-headline")), blank_to_null(text))


def _hrefs(html: Column) -> Column:
    """Link targets of a page without line ends, entities decoded.

    Only pages with an entity other than ``&amp;`` cross to the Arrow step, as one joined text.
    """
    given = F.transform(_tags(html, "a"), lambda a: F.translate(attribute(a, "href"), "\r\n", ""))
    joined = F.array_join(given, "\n")
    rare = decode_entities(F.when(joined.rlike(r"&(?!amp;)#?\w"), joined))
    return F.split(F.coalesce(rare, F.replace(joined, F.lit("&amp;"), F.lit("&"))), "\n", -1)


def first_profile_url(html: Column, platform: Platform) -> Column:
    """First link that leads to a profile, made absolute."""
    links = F.transform(_hrefs(html), lambda h: absolute_profile_url(h, platform))
    first = F.try_element_at(F.filter(links, lambda u: u.isNotNull()), F.lit(1))
    return F.when(F.contains(html, F.lit(platform.profile_path)), first)


_STRING = r"\"(?:[^\"\\]++|\\.)*+\""


def json_strings(block: Column, name: str) -> Column:
    """Every string that stands under a key in valid JSON, at any depth and in the order of the text.

    The string tokens of the text are taken in turn, each key together with a string behind it, so nothing inside
    another string is taken for a key. What may be the key is read as an object of its own, which resolves escapes
    in key and value. (A walk over a VARIANT would lose the order: its objects are sorted by key.)
    """
    tokens = F.regexp_extract_all(block, F.lit(rf"(?s){_STRING}(?:\s*+:\s*+{_STRING})?"), F.lit(0))
    named = F.filter(tokens, lambda t: t.startswith(f'"{name}"') | t.rlike(rf"^\"[^\"]*\\"))
    member = lambda t: F.try_parse_json(F.concat(F.lit("{"), t, F.lit("}")))
    values = F.transform(named, lambda t: F.try_variant_get(member(t), f"$.{name}", "string"))
    return F.filter(values, lambda v: v.isNotNull())


def posted_at(html: Column) -> Column:
    """First readable ``datePublished`` of the JSON-LD blocks, else ``<time datetime>``.

    A block that is no valid JSON, or names a key of one object twice, is passed over.
    """
    block = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
    valid = F.filter(
        F.regexp_extract_all(html, F.lit(block), F.lit(1)),
        lambda b: F.try_parse_json(b).isNotNull(),
    )
    dates = F.flatten(F.transform(valid, lambda b: json_strings(b, "datePublished")))
    readable = F.filter(F.transform(dates, parse_iso), lambda t: t.isNotNull())
    published = F.when(
        F.contains(html, F.lit("ld+json")), F.try_element_at(readable, F.lit(1))
    )
    time_tag = F.regexp_extract(html, rf"(?is)<time\b{_ATTRS}>", 0)
    return F.coalesce(published, parse_iso(attribute(time_tag, "datetime")))


def link_targets(html: Column) -> Column:
    """Every ``href`` of a page in order, with entities decoded."""
    return F.filter(_hrefs(html), lambda h: h != "")


__all__ = [
    "BLOCKED", "OK", "PARSE_ERROR", "attribute", "author_from_slug", "author_headline",
    "decode_entities", "first_profile_url", "is_wall", "json_strings", "link_targets", "main_text",
    "meta_content", "meta_tags", "page_title", "plausible_name", "posted_at",
    "split_named_body", "visible_text", "without_comments",
]
