"""Plain, slow versions of the operators' contracts, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def sha(value: str | bytes) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def pii(text: str | None):
    found = []
    for k, (_, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    found.sort()
    joined = ",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in found)
    return tuple(sum(f[1] == k for f in found) for k in range(4)), joined


def quality(text: str | None):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for j in range(len(words) - 2):
        if windows[tuple(words[j : j + 3])] > 1:
            covered |= {j, j + 1, j + 2}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def bench_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def contamination(docs, items):
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        words = bench_words(text)
        if words:
            for j in range(max(1, len(words) - 12)):
                windows.setdefault(tuple(words[j : j + 13]), set()).add("null" if name is None else str(name))
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        words, hit, names = bench_words(text), set(), set()
        for n in sizes:
            for j in range(len(words) - n + 1):
                if (key := tuple(words[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    names |= windows[key]
        yield doc_id, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(words)


def shingles(text: str | None, width: int) -> frozenset:
    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_duplicates(docs, width: int):
    """doc_id -> (set size, component); rows without id have none."""
    sets = [(i, shingles(t, width)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def repeats(docs, length: int = 50):
    """Rows (doc_id, bytes, removed, runs, digest), in the order given."""
    first: dict[bytes, int] = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        for j in range(len(data) - length + 1 if doc_id is not None else 0):
            w = data[j : j + length]
            first[w] = min(first.get(w, doc_id), doc_id)
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[j : j + length]] < doc_id:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        yield doc_id, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)


def lines(docs, min_sites: int):
    """Rows (doc_id, lines, removed, kept text) of (doc_id, source, text), in the order given."""
    sites, first = {}, {}
    for doc_id, source, text in docs:
        for line in (text.split("\n") if text is not None else ()):
            if key := line.strip(" "):
                sites.setdefault(key, set()).add(source or "")
                if doc_id is not None:
                    first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, _, text in docs:
        own = text.split("\n") if text is not None else []
        kept = [
            x
            for x in own
            if not (k := x.strip(" ")) or len(sites[k]) < min_sites or k not in first or first[k] == doc_id
        ]
        yield doc_id, len(own), len(own) - len(kept), "\n".join(kept)
