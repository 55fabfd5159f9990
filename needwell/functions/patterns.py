"""Regular expressions for the JVM engine.

Patterns are written once in a neutral form. ``U`` makes ``\\b \\w \\s \\d``
Unicode-aware and ``d`` leaves ``\\n`` as the only line end.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from functools import lru_cache

import regex  # knows which texts can begin a match

_FIRST = string.ascii_lowercase + string.digits


def jvm(pattern: str, *, ignore_case: bool = False) -> str:
    """``pattern`` with the flags that give it Unicode semantics on the JVM."""
    return f"(?{'i' if ignore_case else ''}Ud){pattern}"


def _by_first_letter(bodies: Sequence[str]) -> str:
    """Word-anchored alternatives, tried only where the next letter can start them.

    A plain alternation tries every alternative at every word. Sorting them
    under look-aheads for their first letters leaves one or two to try.
    """
    starts = {b: [c for c in _FIRST if regex.match(b, c, partial=True)] for b in bodies}
    arms: dict[tuple[str, ...], str] = {}
    for letter in _FIRST:
        fitting = tuple(b for b in bodies if letter in starts[b])
        if fitting:
            arms[fitting] = arms.get(fitting, "") + letter
    letters = "".join(sorted("".join(arms.values())))
    tried = "|".join(f"(?=[{ls}])(?:{'|'.join(f'(?:{b})' for b in bs)})" for bs, ls in arms.items())
    # an ASCII word character before the letter rules a boundary out, and is cheaper to see than \b
    return rf"(?=[{letters}])(?<![a-z0-9_])\b(?:{tried})"


@lru_cache(maxsize=64)
def any_of(patterns: tuple[str, ...]) -> str:
    """One expression for a whole signal group over lower-cased text.

    Word-anchored patterns must begin with an ASCII letter or digit.
    """
    bodies = [p[2:] for p in patterns if p.startswith(r"\b")]
    parts = [f"(?:{p})" for p in patterns if not p.startswith(r"\b")]
    if bodies:
        parts.insert(0, _by_first_letter(bodies))
    return jvm("|".join(parts))


@lru_cache(maxsize=512)
def first_of(pattern: str) -> str:
    """``pattern`` for :func:`jvm` engines over lower-cased text, tried only at letters that can start it."""
    if not pattern.startswith(r"\b") or pattern.startswith(r"\b\d"):
        return jvm(pattern)
    letters = "".join(c for c in _FIRST if regex.match(pattern[2:], c, partial=True))
    return jvm(rf"(?=[{letters}])(?<![a-z0-9_]){pattern}")


def _needles(tree: Sequence) -> tuple[str, ...] | None:
    """Strings of which every match of a parsed expression has one; None if there are none."""
    runs, found = [""], []
    for op, value in tree:
        inner = None
        if op is re._constants.LITERAL:
            runs[-1] += chr(value)
            continue
        if op is re._constants.AT:
            continue
        if op is re._constants.SUBPATTERN:
            inner = _needles(value[-1])
        elif op is re._constants.BRANCH:
            arms = [_needles(arm) for arm in value[1]]
            inner = None if None in arms else tuple(dict.fromkeys(n for arm in arms for n in arm))
        elif op is re._constants.MAX_REPEAT and value[0]:
            inner = _needles(value[2])
        found.append(inner)
        runs.append("")
    found += [(r,) for r in runs if r]
    return max(filter(None, found), key=lambda ns: (min(map(len, ns)), -len(ns)), default=None)


@lru_cache(maxsize=512)
def needles(patterns: tuple[str, ...]) -> tuple[str, ...] | None:
    """Plain strings of which a text has to contain one if any of the patterns occurs in it; None if that is not known.

    The longest ones that a pattern requires, and of two that contain each other the shorter.
    """
    found = [_needles(re._parser.parse(p)) for p in patterns]
    if None in found:
        return None
    every = {n for ns in found for n in ns}
    return tuple(sorted(n for n in every if not any(m != n and m in n for m in every)))
