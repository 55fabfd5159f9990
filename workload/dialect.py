"""SQL fragments for the twin queries (RE2 regular expressions, DuckDB functions)."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

WORD = r"\p{L}\p{N}_"
START = rf"(?:^|[^{WORD}])"
END = rf"(?:$|[^{WORD}])"
BETWEEN = rf"[^{WORD}.!?\n](?:[^.!?\n]*[^{WORD}.!?\n])?"
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def lit(text: str | None) -> str:
    """A SQL string literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(values: Sequence[str | None], index: str) -> str:
    """The element of a constant list that a zero-based SQL index selects."""
    return f"([{', '.join(lit(v) for v in values)}])[(({index}) % {len(values)} + 1)::BIGINT]"


def folded(text: str | None) -> str | None:
    """A constant after entity decoding and NFKC, which DuckDB cannot do."""
    return None if text is None else unicodedata.normalize("NFKC", html.unescape(text))


def re2(pattern: str) -> str:
    """A neutral pattern without its outer word boundaries, inner ones spelled out."""
    out = pattern.replace(r"\b[^.!?\n]*\b", BETWEEN)
    out = out.removeprefix(r"\b").removesuffix(r"\b")
    return out.replace(r"co\b|", f"co{END}|").replace(r"\w", f"[{WORD}]").replace(r"\d", r"\p{Nd}")


def re2_capture(pattern: str) -> str:
    """Like :func:`re2` with the match itself as group 1."""
    out = pattern.replace(r"\b[^.!?\n]*\b", BETWEEN)
    head = tail = ""
    if out.startswith(r"\b"):
        head, out = START, out[2:]
    if out.endswith(r"\b"):
        tail, out = END, out[:-2]
    out = out.replace(r"co\b|", "co|").replace(r"\w", f"[{WORD}]").replace(r"\d", r"\p{Nd}")
    return f"{head}({out}){tail}"


def matches_any(text: str, patterns: Sequence[str]) -> str:
    """SQL boolean: one of the patterns occurs in the lower-cased text."""
    groups: dict[tuple[bool, bool], list[str]] = {}
    for p in patterns:
        groups.setdefault((p.startswith(r"\b"), p.endswith(r"\b")), []).append(f"(?:{re2(p)})")
    joined = "|".join(
        f"{START if start else ''}(?:{'|'.join(ps)}){END if end else ''}" for (start, end), ps in groups.items()
    )
    return f"regexp_matches(lower(coalesce({text}, '')), {lit(joined)})"


def strip(text: str) -> str:
    """White space removed at both ends."""
    inner = rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$"
    return f"regexp_replace({text}, {lit(inner)}, '', 'g')"


def collapse(text: str) -> str:
    """Control characters dropped, white-space runs to one space, ends trimmed."""
    no_control = rf"regexp_replace({text}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    return f"trim(regexp_replace({no_control}, {lit(SPACE_CLASS + '+')}, ' ', 'g'))"


def with_ctes(*ctes: tuple[str, str]) -> str:
    """A WITH clause out of (name, body) pairs."""
    return "WITH " + ",\n".join(f"{name} AS (\n{body}\n)" for name, body in ctes)
