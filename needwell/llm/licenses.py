"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Every file is compared in parts: each of its first and last EDGE lines, those lines together, the whole
text, and every run of lines, wherever it is. A run has at most as many lines with terms of templates as the
longest template has terms, since a notice can be wrapped over no more; other lines in it are not counted. It
belongs to the first lines if it begins in them, else to the last ones if it ends in them, else to the body.
Runs are scored only in files whose terms, in any number and order, could bring some template to the threshold,
which is known from the whole text; so few files need it and none is missed. A part's weights are term counts
times inverse document frequency. Frequencies are counted over all files, for the terms of the templates; any
other term weighs as one that no file has. So the table of weights is as large as the templates, and scoring
needs no shuffle.

Licences of a family differ by a word or a number, which hardly moves a cosine. So a match is checked before
it counts: what the licence's name stands for (its version, share-alike, non-commercial) has to be in the part;
words of a neighbour in the family (Affero, Lesser, no-derivatives) or a negation may not be in the part, nor in the line
before or after it; an SPDX tag in the part has to name the licence. A refused template leaves the next best one.

A match in the first lines is a header and covers its own file, and so does one in the body. A match in the last
lines, or of the whole text, makes the file a licence file, which covers its folder as well. With `apart`, as in the query, it
does so whether or not the first lines match better or as well, a tie is of the file's kind, and a file with
a licence file's name (LICENSE, COPYING) is one by any match; otherwise only the best match decides, the
first lines' before an equal one. A file without a licence of
its own takes that of the nearest folder above it which has one: the distinct folders are unfolded to
their ancestors (a path's depth bounds that), joined with the licensed folders, and reduced to the deepest
match; the files then join their folder. Hot folders are only ever on the side of a join that can be split.

Defined cases: a null or empty text has no licence of its own; a null path has no folder and inherits
nothing; of equal scores the first template by name wins; the score of a file without a licence is that of its
best edge lines or whole text, refused templates aside; in one folder the file with the best score counts, then
the smallest path; repeated rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .staging import staged

EDGE = 3
THRESHOLD = 0.7

#: fixed values: customary statements, titles and notices, by licence
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "Dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "GNU General Public License Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}

#: fixed values: what tells licences of a family apart
MARKS = {
    "affero": r"\baffero\b|\bagpl",
    "lesser": r"\blesser\b|\blgpl",
    "version 2": r"\b(?:version|v\.?|l?gpl|l?gplv)[\s-]*2(?:\.0)?(?![.\d]*\d)",
    "version 2.1": r"\b(?:version|v\.?|l?gpl|l?gplv)[\s-]*2\.1\b",
    "version 3": r"\b(?:version|v\.?|[al]?gpl|[al]?gplv)[\s-]*3(?:\.0)?(?![.\d]*\d)",
    "non-commercial": r"\bnon[\s-]?commercial\b|\bby[\s-]nc\b",
    "share-alike": r"\bshare[\s-]?alike\b|\bby(?:[\s-]nc)?-sa\b",
    "no-derivatives": r"\bno[\s-]?deriv\w*|\bby(?:[\s-]nc)?-nd\b",
    "4.0": r"\b4\.0\b",
    "2.0": r"\b2\.0\b",
    "2 clauses": r"\b2-clause\b|\bsimplified bsd\b|\bmust\s+reproduce\s+the\s+above\b",
    "endorsement": r"\b3-clause\b|\bnew bsd\b|\bneither\s+the\s+names?\b|\bto\s+endorse\s+or\s+promote\b",
}

#: fixed values: marks that a licence has to have, and those of its neighbours that it may not have
TOLD_APART: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "AGPL-3.0": (("affero", "version 3"), ()),
    "Apache-2.0": (("2.0",), ()),
    "BSD-2-Clause": (("2 clauses",), ("endorsement",)),
    "BSD-3-Clause": (("endorsement",), ()),
    "CC-BY-4.0": (("4.0",), ("non-commercial", "share-alike", "no-derivatives")),
    "CC-BY-NC-4.0": (("4.0", "non-commercial"), ("share-alike", "no-derivatives")),
    "CC-BY-NC-ND-4.0": (("4.0", "non-commercial", "no-derivatives"), ()),
    "CC-BY-NC-SA-4.0": (("4.0", "non-commercial", "share-alike"), ()),
    "CC-BY-ND-4.0": (("4.0", "no-derivatives"), ("non-commercial",)),
    "CC-BY-SA-4.0": (("4.0", "share-alike"), ("non-commercial",)),
    "GPL-2.0": (("version 2",), ("affero", "lesser")),
    "GPL-3.0": (("version 3",), ("affero", "lesser")),
    "LGPL-2.1": (("lesser", "version 2.1"), ("affero",)),
    "LGPL-3.0": (("lesser", "version 3"), ("affero",)),
    "MPL-2.0": (("2.0",), ()),
}

_MARKS = {mark: re.compile(pattern, re.I) for mark, pattern in MARKS.items()}
_DENIED = re.compile(r"\b(?:not|no longer|never)\s+(?:\w+\s+){0,2}(?:licen[cs]ed|released|distributed|covered|available)\b", re.I)
_TAG = re.compile(r"SPDX-License-Identifier\s*:([^\n]*)", re.I)
_ID_TAIL = re.compile(r"(?:-only|-or-later|\+)$", re.I)


def stands(licence: str, part: str, around: str) -> bool:
    """Whether a part that is close to a template states that licence; `around` is the part and a line more on either side."""
    needed, barred = TOLD_APART.get(licence, ((), ()))
    if _DENIED.search(around) or any(_MARKS[m].search(around) for m in barred) or not all(_MARKS[m].search(part) for m in needed):
        return False
    tags = _TAG.findall(part)
    named = {_ID_TAIL.sub("", i).lower() for tag in tags for i in re.findall(r"[\w.+-]+", tag)}
    return not tags or licence.lower() in named


#: names of licence files, such as LICENSE, LICENSE-MIT, mit-licence.txt, COPYING.LESSER
NAMED = r"(?i)(?:^|/)(?:[^/]*[-_])?(?:(?:un)?licen[cs]es?|copying)(?:[-_.][^/]*)?$"

_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def parts(text: str) -> list[tuple[str, str, str]]:
    """(place, part, part and a line more on either side): first lines, last lines, and the whole text."""
    lines = [line for line in text.split("\n") if line.strip()]
    edge = min(EDGE, len(lines))

    def cut(place: str, start: int, end: int) -> tuple[str, str, str]:
        return place, " ".join(lines[start:end]), "\n".join(lines[max(start - 1, 0) : end + 1])

    first = [cut("header", i, i + 1) for i in range(edge)] + [cut("header", 0, edge)]
    last = [cut("file", i, i + 1) for i in range(len(lines) - edge, len(lines))] + [cut("file", len(lines) - edge, len(lines))]
    return [*first, *last, ("file", text, text)]


class Scorer:
    """Cosine of texts to the templates, under given weights of terms."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[str, int], total: int):
        self.weight = {t: math.log((total + 1) / (n + 1)) + 1 for t, n in frequency.items()}
        self.unseen = math.log(total + 1) + 1
        self.vectors = []
        self.lengths = []
        self.holders: dict[str, list[tuple[int, float]]] = {}
        for name in sorted(templates):
            for text in templates[name]:
                counts = Counter(terms(text))
                norm = math.sqrt(sum((n * self.of(t)) ** 2 for t, n in counts.items()))
                for t, n in counts.items():
                    self.holders.setdefault(t, []).append((len(self.vectors), n * self.of(t) / norm))
                self.vectors.append(name)
                self.lengths.append(sum(counts.values()))

    def of(self, term: str) -> float:
        return self.weight.get(term, self.unseen)

    def best(self, part: str, around: str | None = None) -> tuple[float, str | None]:
        """The highest cosine that is not refused, and its licence; a part alone has nothing around it."""
        counts = Counter(terms(part))
        dots: dict[int, float] = {}
        for t in counts.keys() & self.holders.keys():
            own = counts[t] * self.of(t)
            for vector, weight in self.holders[t]:
                dots[vector] = dots.get(vector, 0.0) + own * weight
        if not dots:
            return 0.0, None
        norm = math.sqrt(math.fsum((n * self.of(t)) ** 2 for t, n in counts.items()))
        return self.chosen({v: round(d / norm, 6) for v, d in dots.items()}, part, part if around is None else around)

    def chosen(self, scores: dict[int, float], part: str, around: str) -> tuple[float, str | None]:
        """The best score below the threshold, or of a licence that the part states."""
        for score, vector in sorted(((s, -v) for v, s in scores.items()), reverse=True):
            name = self.vectors[-vector]
            if score < THRESHOLD or stands(name, part, around):
                return score, name
        return 0.0, None

    def possible(self, text: str) -> set[int]:
        """Templates that a text with these terms may reach the threshold of, whatever their number: by Cauchy-Schwarz."""
        most: dict[int, float] = {}
        for t in self.holders.keys() & set(terms(text)):
            for vector, weight in self.holders[t]:
                most[vector] = most.get(vector, 0.0) + weight * weight
        return {v for v, square in most.items() if square >= THRESHOLD**2 - 1e-5}

    def runs(self, text: str) -> list[tuple[float, str | None, str]]:
        """Score, licence and place of the runs of lines that reach the threshold."""
        vectors = self.possible(text)
        if not vectors:
            return []
        lines = [line for line in text.split("\n") if line.strip()]
        rows = [Counter(terms(line)) for line in lines]
        longest = max(self.lengths[v] for v in vectors)
        held = {t: [(v, w) for v, w in self.holders[t] if v in vectors] for t in self.holders.keys() & set().union(*rows)}
        bears = [any(held.get(t) for t in row) for row in rows]
        found = []
        for i in range(len(rows)):
            if not bears[i]:
                continue
            counts: Counter[str] = Counter()
            dots = dict.fromkeys(vectors, 0.0)
            square, used = 0.0, 0
            for j in range(i, len(rows)):
                used += bears[j]
                if used > longest:
                    break
                for t, n in rows[j].items():
                    weight = self.of(t)
                    square += n * (2 * counts[t] + n) * weight * weight
                    counts[t] += n
                    for v, w in held.get(t, ()):
                        dots[v] += n * weight * w
                if bears[j]:
                    norm = math.sqrt(square)
                    scores = {v: round(d / norm, 6) for v, d in dots.items() if d >= (THRESHOLD - 1e-5) * norm}
                    if not scores:
                        continue
                    score, name = self.chosen(scores, "\n".join(lines[i : j + 1]), "\n".join(lines[max(i - 1, 0) : j + 2]))
                    if score >= THRESHOLD:
                        last = j >= len(rows) - EDGE
                        places = ("header",) * (i < EDGE) + ("file",) * last or ("body",)
                        found += [(score, name, place) for place in places]
        return found

    def scan(self, text: str) -> tuple[str | None, float, str | None, str | None, float]:
        """Licence, score and place of the best part that reaches the threshold; the best score otherwise.

        Then licence and score of the best file part alone, likewise.
        """
        found = [(*self.best(part, around), place) for place, part, around in parts(text)] + self.runs(text) if text else []
        score, name, place = max(found, key=lambda f: f[0], default=(0.0, None, None))
        own = (name, score, place) if score >= THRESHOLD else (None, score, None)
        score, name, _ = max((f for f in found if f[2] == "file"), key=lambda f: f[0], default=(0.0, None, None))
        return *own, name if score >= THRESHOLD else None, score


def _frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Number of files that hold each term of the templates, and number of files: a row per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter({"": batch.num_rows})
            for text in batch.column("text"):
                counts.update(vocabulary.intersection(terms(text.as_py() or "")))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def own_licenses(files: DataFrame, keep: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The columns kept, and own_license, score, place, file_license, file_score of every file."""
    vocabulary = {t for texts in templates.values() for text in texts for t in terms(text)}
    frequency, total = _frequencies(files, vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(templates, frequency, total)
        for batch in batches:
            found = [scorer.scan(text.as_py() or "") for text in batch.column("text")]
            columns = zip(*found, strict=True) if found else ((),) * 5
            kinds = (pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                [*keep, "own_license", "score", "place", "file_license", "file_score"],
            )

    return files.select(*keep, "text").mapInArrow(
        run, f"{schema}, own_license string, score double, place string, file_license string, file_score double"
    )


def folder(path: Column) -> Column:
    """All of a path but its last name; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame, apart: bool = False) -> DataFrame:
    """folder, license, from_folder: for each folder of files, the nearest licensed one at or above it."""
    if apart:
        license_ = F.coalesce("file_license", F.when(F.col("path").rlike(NAMED), F.col("own_license")))
        score = F.when(F.col("file_license").isNotNull(), F.col("file_score")).otherwise(F.col("score"))
    else:
        license_, score = F.when(F.col("place") == "file", F.col("own_license")), F.col("score")
    placed = files.where("path IS NOT NULL").select(
        folder(F.col("path")).alias("folder"), "path", license_.alias("license"), score.alias("score")
    )
    best = F.min(F.struct((-F.col("score")).alias("s"), "path", "license"))
    licensed = placed.where("license IS NOT NULL").groupBy("folder").agg(best["license"].alias("license"))
    names = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))
    steps = placed.select("folder").distinct().select("folder", F.explode(F.array_distinct(above)).alias("above"))
    joined = steps.join(licensed.withColumnRenamed("folder", "above"), "above")
    return joined.groupBy("folder").agg(F.max(F.struct(F.length("above").alias("n"), "above", "license")).alias("hit")).select(
        "folder", F.col("hit.license").alias("inherited"), F.col("hit.above").alias("from_folder")
    )


def license_scan(
    files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, keep: tuple[str, ...] = (), apart: bool = False
) -> DataFrame:
    """path, the columns kept, own_license, score, place, license, from_folder of files (path, text)."""
    scanned = staged(own_licenses(files, ["path", *keep], templates), "licenses")
    tie = F.lit(apart) & F.col("file_license").isNotNull() & (F.col("file_score") >= F.col("score"))
    above = inherited(scanned, apart).withColumnRenamed("folder", "_folder")
    joined = scanned.join(above, folder(F.col("path")) == F.col("_folder"), "left")
    return joined.select(
        "path",
        *keep,
        "own_license",
        "score",
        F.when(tie, F.lit("file")).otherwise(F.col("place")).alias("place"),
        F.coalesce("own_license", "inherited").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from_folder")).alias("from_folder"),
    )


def document_path(doc_id: Column, source: Column, lang: Column) -> Column:
    """A tree for documents, which have no paths: source, language, then a folder per digit of the id.

    Zeros at the end of an id are left out, so rounder ids are files nearer to the root.
    """
    digits = F.regexp_replace(doc_id.cast("string"), "0+$", "")
    folders = F.regexp_replace(F.left(digits, F.greatest(F.length(digits) - 1, F.lit(0))), "([0-9-])", "$1/")
    start = F.concat_ws("/", F.coalesce(source, F.lit("none")), F.coalesce(lang, F.lit("none")))
    return F.concat(start, F.lit("/"), folders, doc_id.cast("string"), F.lit(".txt"))


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every document."""
    docs = table(spark, sf_dir, "documents")
    path = document_path(F.col("doc_id"), F.col("source"), F.col("lang"))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",), apart=True)
