"""Rule-based post classification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from needwell import config as c
from needwell.functions import lexicon as lx
from needwell.functions.patterns import any_of, first_of, needles


def lowered(text: Column) -> Column:
    """The form all signals are searched in; NULL counts as empty text."""
    return F.lower(F.coalesce(text, F.lit("")))


def _may_occur(low: Column, patterns: Sequence[str]) -> Column:
    """Whether a text has one of the plain strings without which no pattern can occur.

    Finding a plain string costs a hundredth of a regular expression, and most texts have none.
    """
    plain = needles(tuple(patterns))
    return F.lit(True) if plain is None else reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in plain])


def occurs(low: Column, patterns: Sequence[str]) -> Column:
    """At least one pattern of a group occurs in lower-cased text."""
    return _may_occur(low, patterns) & low.rlike(any_of(tuple(patterns)))


def signals_any(text: Column, patterns: Sequence[str]) -> Column:
    """At least one pattern of a group occurs."""
    return occurs(lowered(text), patterns)


def signal_hits_lowered(low: Column, patterns: Sequence[str]) -> Column:
    """:func:`signal_hits` over a column that is lower-cased already."""
    firsts = [
        F.when(
            _may_occur(low, [p]),
            F.trim(F.regexp_replace(F.regexp_extract(low, first_of(p), 0), r"(?U)\s+", " ")),
        ).otherwise("")
        for p in patterns
    ]
    return F.array_distinct(F.filter(F.array(*firsts), lambda hit: hit != ""))


def signal_hits(text: Column, patterns: Sequence[str]) -> Column:
    """First match of each pattern, white space collapsed, without repeats."""
    return signal_hits_lowered(lowered(text), patterns)


def has_request_lowered(low: Column) -> Column:
    asks = occurs(low, lx.REQUEST) | occurs(low, lx.CALL_TO_ACTION)
    return asks & occurs(low, lx.TARGET)


def has_request(text: Column) -> Column:
    """A request or a call to action, together with something asked for."""
    return has_request_lowered(lowered(text))


def category_lowered(low: Column, low_author: Column) -> Column:
    """:func:`category` over columns that are lower-cased already.

    One ``CASE`` with one expression per group, so later groups are only searched
    when the earlier ones did not match.
    """
    company = occurs(low_author, lx.COMPANY_AUTHOR)
    return (
        F.when(occurs(low, lx.JOB), c.JOB_POSTING)
        .when(occurs(low, lx.RECRUITER), c.RECRUITER_STAFFING)
        .when(company | occurs(low, lx.SELF_PROMOTION), c.COMPETITOR_SELFPROMO)
        .when(occurs(low, lx.CONTENT_NOISE), c.CONTENT_NOISE)
        .when(has_request_lowered(low), c.CLIENT_LEAD)
        .otherwise(c.UNCLEAR)
    )


def category(text: Column, author_name: Column) -> Column:
    """Category by precedence: each junk class outranks any request."""
    return category_lowered(lowered(text), lowered(author_name))


def is_client(category_col: Column) -> Column:
    """The only category that keeps a real score."""
    return category_col == c.CLIENT_LEAD


def all_signals_lowered(low: Column, low_author: Column) -> Column:
    """:func:`all_signals` over columns that are lower-cased already."""
    return F.struct(
        *[
            signal_hits_lowered(low_author if name == "company_author" else low, patterns).alias(name)
            for name, patterns in lx.GROUPS.items()
        ]
    )


def all_signals(text: Column, author_name: Column) -> Column:
    """STRUCT of the hits of every group, in reporting order."""
    return all_signals_lowered(lowered(text), lowered(author_name))
