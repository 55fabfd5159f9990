"""Text and name cleaning."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from needwell.functions.lexicon import STOP_WORDS
from needwell.functions.patterns import jvm

# White space, control characters and pictographs that cleaning knows.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CONTROL_CLASS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EMOJI_CLASS = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}"
    r"\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{200D}]+"
)
# Characters that NFKC never changes: ASCII, Latin-1 letters, Cyrillic letters, CJK ideographs.
NFKC_STABLE = r"\x00-\x7f\u00c0-\u00ff\u0400-\u0481\u048a-\u052f\u4e00-\u9fff"
# Name and need limits.
RUN_ON_NAME_LENGTH = 12
NEED_TEXT_LENGTH = 500
NAME_MAX_LENGTH = 60
NAME_MAX_SPACES = 6


def _fold_udf(unescape: bool, nfkc: bool):
    """Arrow UDF for the two steps the JVM lacks.

    Defined in a closure, so workers receive the function itself and need no
    copy of this package.
    """

    def fold_value(value: str | None) -> str | None:
        if value is None:
            return None
        decoded = html.unescape(value) if unescape and "&" in value else value
        return unicodedata.normalize("NFKC", decoded) if nfkc else decoded

    def fold(values: pa.Array) -> pa.Array:
        return pa.array([fold_value(v) for v in values.to_pylist()], pa.string())

    # marked so that a filter on its result is not pushed below it, which would
    # send every text through Python twice
    return F.arrow_udf(fold, StringType()).asNondeterministic()


def _only_where(needed: Column, udf, text: Column) -> Column:
    """Send only the rows that need Python to it; the rest cross as NULL."""
    return F.coalesce(udf(F.when(needed, text)), text)


def _may_change_under_nfkc(text: Column) -> Column:
    # ASCII is known by its length; a run to the end is searched far faster than a character outside a class
    return (F.octet_length(text) != F.char_length(text)) & ~text.rlike(rf"\A[{NFKC_STABLE}]*\z")


def normalize_unicode(text: Column) -> Column:
    """NFKC form; rows of stable characters only never leave the JVM."""
    return _only_where(_may_change_under_nfkc(text), _fold_udf(unescape=False, nfkc=True), text)


def decode_entities(text: Column) -> Column:
    """HTML entities decoded; rows without ``&`` never leave the JVM."""
    return _only_where(F.contains(text, F.lit("&")), _fold_udf(unescape=True, nfkc=False), text)


def fold_text(text: Column) -> Column:
    """Entity decoding followed by NFKC in one Python round trip."""
    needed = F.contains(text, F.lit("&")) | _may_change_under_nfkc(text)
    return _only_where(needed, _fold_udf(unescape=True, nfkc=True), text)


def strip(text: Column) -> Column:
    """White space removed at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_control_chars(text: Column) -> Column:
    """Control characters removed, tab and line ends kept."""
    return F.regexp_replace(text, CONTROL_CLASS, "")


def collapse_whitespace(text: Column) -> Column:
    """White-space runs become one space; ends trimmed."""
    # a lone plain space is already right, so only other runs are rewritten; printable ASCII is ruled out first
    space = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    runs = rf"[\x00-\x1f\x7f-\uffff&&[{space}]][{space}]*| [{space}]+"
    return strip(F.regexp_replace(text, runs, " "))


def strip_emoji(text: Column) -> Column:
    """Pictographs, arrows, flags, selectors and joiners removed."""
    return F.regexp_replace(text, EMOJI_CLASS, "")


def tidy(folded: Column) -> Column:
    """The JVM half of :func:`clean_text`, for text that is already folded."""
    return F.coalesce(collapse_whitespace(strip_control_chars(folded)), F.lit(""))


def has_content(folded: Column) -> Column:
    """Cleaning will leave something; stops at the first visible character."""
    blank = r"\x00-\x20\x7f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return F.coalesce(folded.rlike(f"[^{blank}]"), F.lit(False))


def clean_text(text: Column) -> Column:
    """Entities, NFKC, control characters, white space, in this order; NULL gives ''."""
    return tidy(fold_text(text))


def last_without_digit(tokens: Column) -> Column:
    """Position of the last token free of digits, 0 when there is none."""
    positions = F.transform(tokens, lambda t, i: F.when(~t.rlike(r"(?U)\d"), i + 1))
    return F.coalesce(F.array_max(positions), F.lit(0))


def tidy_author_name(folded: Column) -> Column:
    """Display name of an author from folded text, trailing id tokens dropped."""
    name = collapse_whitespace(strip_emoji(tidy(folded)))
    tokens = F.split(name, " ", -1)
    # the first token always stays; arrays, because a repeated regex group recurses per token
    return F.array_join(F.slice(tokens, 1, F.greatest(last_without_digit(tokens), F.lit(1))), " ")


def name_low_confidence(name: Column) -> Column:
    """Empty, still carrying a digit, or one long run-on token."""
    one_token = ~F.contains(name, F.lit(" "))
    return (
        (name == "")
        | name.rlike(r"(?U)\d")
        | (one_token & (F.char_length(name) >= RUN_ON_NAME_LENGTH))
    )


def clean_author_name(name: Column) -> Column:
    """STRUCT(value, low_confidence) of an author name."""
    value = tidy_author_name(fold_text(name))
    return F.struct(value.alias("value"), name_low_confidence(value).alias("low_confidence"))


def blank_to_null(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def company_from_headline(headline: Column) -> Column:
    """What follows the word ``at`` or an ``@`` in a headline, else NULL."""
    found = F.regexp_extract(headline, jvm(r"(?:\bat\b|@)\s+(.+?)\s*$", ignore_case=True), 1)
    return F.nullif(strip(found), F.lit(""))


def need_excerpt(post_text: Column) -> Column:
    """Leading characters of the raw post that stand for the need."""
    return F.substring(post_text, 1, NEED_TEXT_LENGTH)


def content_tokens(need: Column) -> Column:
    """ASCII words of a need without stop words, unless nothing else is there."""
    words = F.regexp_extract_all(F.lower(need), F.lit(r"[a-z0-9]+"), F.lit(0))
    content = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def plausible_name(candidate: Column) -> Column:
    """A name, not a sentence: short and with few spaces."""
    spaces = F.char_length(candidate) - F.char_length(F.replace(candidate, F.lit(" "), F.lit("")))
    return F.char_length(candidate).between(1, NAME_MAX_LENGTH) & (spaces <= NAME_MAX_SPACES)


def split_named_body(text: Column, label: str) -> Column:
    """STRUCT(name, body) of ``<name> on <label>: <body>``; both NULL without that form."""
    marker = rf"\s+on\s+{label}\b"
    name = F.regexp_extract(text, jvm(rf"^((?s:.*?)){marker}", ignore_case=True), 1)
    body = F.regexp_extract(text, jvm(rf"{marker}((?s:.*))$", ignore_case=True), 1)
    body = strip(F.ltrim(body, F.lit(" :–—-")))
    return F.struct(
        F.nullif(strip(name), F.lit("")).alias("name"),
        F.nullif(body, F.lit("")).alias("body"),
    )
