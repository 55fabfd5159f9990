"""Facts a post states about its author: company, email, website, phone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from needwell.functions.patterns import jvm
from needwell.functions.text import company_from_headline, strip
from needwell.functions.urls import normalize_url

# Shapes of the facts.
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_TOKEN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL_TOKEN = r"(?:https?://|www\.)[^\s<>()\[\]{}\"']+"
URL_TRAILING = ".,);:]}\"'"
COMPANY_WORD = r"[A-Z][A-Za-z0-9&.\-]*"
COMPANY_NAME = rf"{COMPANY_WORD}(?:\s+{COMPANY_WORD}){{0,4}}"
COMPANY_SUBJECT = rf"\b({COMPANY_NAME})\s+is\s+(?:looking|hiring|seeking)\b"
COMPANY_SELF = rf"\b[Ww]e(?:'re| are)\s+({COMPANY_NAME})\b"
# First words that never name a company.
NOT_A_COMPANY = (
    "i", "we", "our", "the", "this", "that", "they", "it", "you",
    "he", "she", "here", "today", "hi", "hey", "hello",
    "hiring", "looking", "seeking", "urgent",
)

# Dialling rules: region, calling code, national number pattern, trunk prefix.
DIALLING_RULES = (
    ("US", "1", r"[2-9]\d{2}[2-9]\d{6}", "1"),
    ("IN", "91", r"[1-9]\d{9}", "0"),
    ("GB", "44", r"[1-9]\d{8,9}", "0"),
    ("DE", "49", r"[1-9]\d{5,12}", "0"),
    ("FR", "33", r"[1-9]\d{8}", "0"),
    ("ES", "34", r"[5-9]\d{8}", ""),
    ("AU", "61", r"[1-9]\d{8}", "0"),
    ("SG", "65", r"[3689]\d{7}", ""),
)


def normalize_email(email: Column) -> Column:
    """Trimmed, lower-cased address of the shape ``x@y.z``, else NULL."""
    candidate = F.lower(strip(email))
    return F.when(candidate.rlike(jvm(EMAIL_SHAPE)), candidate)


def first_email(text: Column) -> Column:
    """First address in a text, lower-cased."""
    # Every token match already has the valid shape, and the first match starts
    # where its run of address characters starts: one anchored search is enough.
    token = rf"(?<![A-Za-z0-9._%+\-]){EMAIL_TOKEN}"
    return F.when(
        F.contains(text, F.lit("@")),
        F.nullif(F.lower(F.regexp_extract(text, token, 0)), F.lit("")),
    )


def first_website(text: Column) -> Column:
    """First explicit URL in a text, normalised."""
    tokens = F.regexp_extract_all(text, F.lit(jvm(URL_TOKEN, ignore_case=True)), F.lit(0))

    def absolute(token: Column) -> Column:
        trimmed = F.rtrim(token, F.lit(URL_TRAILING))
        has_scheme = F.lower(trimmed).startswith("http")
        return F.when(has_scheme, trimmed).otherwise(F.concat(F.lit("https://"), trimmed))

    urls = F.transform(tokens, lambda t: normalize_url(absolute(t)))
    found = F.try_element_at(F.filter(urls, lambda u: u.isNotNull()), F.lit(1))
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("://")) | F.contains(low, F.lit("www.")), found)


def _contains_any(text: Column, *words: str) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _named_company(text: Column, pattern: str) -> Column:
    name = strip(F.regexp_extract(text, jvm(pattern), 1))
    first_word = F.lower(F.regexp_extract(name, r"(?U)^(\S+)", 1))
    return F.when((name != "") & ~first_word.isin(*NOT_A_COMPANY), name)


def company_from_post(text: Column) -> Column:
    """Company named as the subject of an ask, or by self-identification.

    Substring tests for words each form must contain come before its regex.
    """
    subject = F.when(
        _contains_any(text, "looking", "hiring", "seeking"), _named_company(text, COMPANY_SUBJECT)
    )
    selfid = F.when(_contains_any(text, "e're", "e are"), _named_company(text, COMPANY_SELF))
    return F.coalesce(subject, selfid)


def company_name(text: Column, headline: Column) -> Column:
    """Company from the post, else from the headline."""
    return F.coalesce(company_from_post(text), company_from_headline(headline))


def enrichment(text: Column, headline: Column) -> Column:
    """STRUCT(company, contact_email, website) of a post."""
    return F.struct(
        company_name(text, headline).alias("company"),
        first_email(text).alias("contact_email"),
        first_website(text).alias("website"),
    )
