"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Templates are short notices, SPDX tags and full licence texts. Passages are windows of a template's length, across lines,
wherever a cue word stands in them: at every word for short notices, in steps of an eighth for full texts. Terms are words,
lower-cased and without outer punctuation; weights are (1 + ln count) * idf, the idf coming from the document frequencies
of the templates' terms over all documents. Words that no template has share one axis of the fixed weight OTHER, so that what
matches does not depend on the size of the table. A short notice counts only with its licence's own words (KEYS). The
template with the best cosine of LEAST or more, of equals the longest, is a document's own licence.

A document at least half of whose words are in matching passages is a licence file of its directory (the path without
its last part). A document without a licence of its own takes that of the nearest ancestor directory which has a
licence file (of several, the best score, then the smallest doc_id). Directories are resolved once each, by joins on
their ancestors; files are joined to resolved directories.

Null and empty texts match nothing; a null path has no ancestors. Rows that repeat are scanned alike. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.text import Text, Words, slices

LEAST = 0.6
#: The idf of a word in one document of twenty.
OTHER = 4.0
#: Short notices by which the licences' own texts ask to be named.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License version 3"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2", "GNU General Public License version 2"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"],
    "ISC": ["Licensed under the ISC License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "Copyright, all rights reserved"],
}
#: Files of licence_texts.
FULL = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "BSD-3-Clause": "BSD", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-3.0": "LGPL-3",
    "MPL-2.0": "MPL-2.0", "ISC": "ISC", "Unlicense": "Unlicense",
}
TAGS = {name: [name] for name in TEMPLATES if name != "proprietary"}
for _name in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0"):
    TAGS[_name] = [_name, f"{_name}-only", f"{_name}-or-later", f"{_name}+"]
#: A passage is compared only if it has one of these.
CUES = {
    "license", "licensed", "licence", "redistribution", "cc", "creative", "unencumbered", "rights", "gnu", "mozilla",
    "permission", "spdx-license-identifier",
}
#: Of these words, a short notice must have those that its template has.
KEYS = {
    "apache", "mit", "bsd", "gnu", "lesser", "affero", "mozilla", "cc", "by", "by-sa", "by-nc", "commons", "sharealike", "noncommercial",
    "isc", "unencumbered", "reserved", "redistribution",
} | {tag.lower() for tags in TAGS.values() for tag in tags}
_OUTER = ".,;:!?()[]{}<>\"'*#-/"


def _terms(text: str) -> list[str]:
    return [w for w in (x.strip(_OUTER).lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text)) if w]


_SHORT = [(name, _terms(x)) for name, texts in TEMPLATES.items() for x in texts]
_SHORT += [(name, _terms(f"SPDX-License-Identifier: {tag}")) for name, tags in TAGS.items() for tag in tags]
_LONG = [(name, _terms(pkgutil.get_data("tenure.llm", f"licence_texts/{file}.txt").decode())) for name, file in FULL.items()]
VOCABULARY = sorted({w for _, terms in _SHORT + _LONG for w in terms} | CUES)


def _numbers(distinct: pa.Array) -> np.ndarray:
    """The template term of each distinct word, or len(VOCABULARY)."""
    plain = pc.ascii_lower(pc.utf8_trim(distinct, characters=_OUTER))
    return pc.fill_null(pc.index_in(plain, value_set=pa.array(VOCABULARY)), len(VOCABULARY)).to_numpy(zero_copy_only=False).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0):
            words = Words(Text(part.column(0)))
            ids, distinct = words.encode()
            term = _numbers(distinct)[ids]
            at = np.flatnonzero(term < len(VOCABULARY))
            pair = np.unique(words.row[at] * len(VOCABULARY) + term[at])
            count = np.bincount(pair % len(VOCABULARY), minlength=len(VOCABULARY))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(VOCABULARY))), pa.array(count)], ["term", "count"])


def idf(docs: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the term)) + 1 of each template term, and OTHER for all other words."""
    total = docs.count()
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "term long, count long")
    found = dict(rows.groupBy("term").agg(F.sum("count")).collect())
    out = [math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in range(len(VOCABULARY))]
    return np.array([*out, OTHER])


def _vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(1, counts)), 0) * weights
    return v / np.maximum(1e-300, np.sqrt((v * v).sum(1, keepdims=True)))


class Templates:
    """Templates of a kind over the terms that they use; `number` has the place of every term of VOCABULARY among those."""

    def __init__(self, templates: list[tuple[str, list[str]]], weights: np.ndarray, short: bool):
        own = sorted({w for _, terms in templates for w in terms})
        place = {w: i for i, w in enumerate(own)}
        self.number = np.array([place.get(w, len(own)) for w in VOCABULARY] + [len(own)])
        self.weights = np.array([*(weights[VOCABULARY.index(w)] for w in own), weights[-1]])
        self.names = [name for name, _ in templates]
        self.lengths = np.array([len(terms) for _, terms in templates])
        counts = np.zeros((len(templates), len(own) + 1))
        self.must = np.zeros((len(templates), len(own) + 1), bool)
        for i, (_, terms) in enumerate(templates):
            for w in terms:
                counts[i, place[w]] += 1
                self.must[i, place[w]] |= short and w in KEYS
        self.vectors = _vectors(counts, self.weights)
        self.short = short


def scan(text: Text, kinds: list[Templates]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Each row's licence, its cosine, and the share of words in matching passages."""
    words = Words(text)
    ids, distinct = words.encode()
    numbers = _numbers(distinct)
    term = numbers[ids]
    cues = np.flatnonzero(np.isin(numbers, [VOCABULARY.index(c) for c in CUES])[ids])
    best, score, covered = [None] * text.n, np.zeros(text.n), np.zeros(len(words) + 1, np.int64)
    rank = [(0.0, 0)] * text.n
    row_first, row_end = words.first[words.row[cues]], words.first[words.row[cues] + 1]
    for kind in kinds:
        mine = kind.number[term]
        known = np.concatenate([[0], np.cumsum(mine < len(kind.weights) - 1)])
        for length in np.unique(kind.lengths).tolist() if len(cues) else ():
            these = np.flatnonzero(kind.lengths == length)
            step = 1 if kind.short else max(1, length // 8)
            # Windows at multiples of step from the row's first word that hold a cue, and the row's last window.
            last = np.maximum(row_first, row_end - length)
            lo, hi = np.maximum(row_first, cues - length + 1), np.minimum(cues, last)
            k = -(-(lo - row_first) // step)
            many = np.maximum(0, (hi - row_first) // step - k + 1)
            at = np.repeat(row_first + k * step, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * step
            begin = np.unique(np.concatenate([at, last[lo <= last]]))
            end = np.minimum(begin + length, words.first[words.row[begin] + 1])
            full = known[end] - known[begin] >= 0.4 * length
            begin, end = begin[full], end[full]
            for run in range(0, len(begin), 500):
                a, b = begin[run : run + 500], end[run : run + 500]
                size = b - a
                which = np.repeat(np.arange(len(a)), size)
                inside = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                width = len(kind.weights)
                counts = np.bincount(which * width + mine[inside], minlength=len(a) * width).reshape(len(a), width)
                cosine = _vectors(counts, kind.weights) @ kind.vectors[these].T
                if kind.short:
                    cosine[(counts == 0).astype(np.float32) @ kind.must[these].T.astype(np.float32) > 0] = 0
                top = cosine.argmax(1)
                for i in np.flatnonzero(cosine.max(1) >= LEAST):
                    row = words.row[a[i]]
                    covered[a[i] : b[i]] = 1
                    value = round(float(cosine[i, top[i]]), 6), length
                    if value > rank[row]:
                        rank[row], score[row], best[row] = value, cosine[i, top[i]], kind.names[these[top[i]]]
    share = np.diff(np.concatenate([[0], np.cumsum(covered[:-1])])[words.first]) / np.maximum(1, words.count)
    return best, np.minimum(1.0, score), share


def directory(path: Column) -> Column:
    """The path without its last part; the empty path is the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, score, is_license_file, license, inherited_from of docs(doc_id, path, text)."""
    weights = idf(docs)
    kinds = [Templates(_SHORT, weights, True), Templates(_LONG, weights, False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                best, score, share = scan(Text(part.column(2)), kinds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(best, pa.string()), pa.array(score), pa.array(share >= 0.5)],
                    ["doc_id", "path", "own_license", "score", "is_license_file"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(run, "doc_id long, path string, own_license string, score double, is_license_file boolean")
    found = found.withColumn("_dir", directory(F.col("path")))
    grants = found.filter("is_license_file and own_license is not null and _dir is not null").groupBy(F.col("_dir").alias("_at")).agg(
        F.max_by("own_license", F.struct("score", F.expr("-doc_id"))).alias("_granted")
    )
    parts = F.split("_dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = found.select("_dir").filter("_dir is not null").distinct().withColumn("_at", F.explode(F.array_distinct(chain)))
    nearest = above.join(grants, "_at").groupBy("_dir").agg(F.max_by(F.struct("_at", "_granted"), F.length("_at")).alias("_near"))
    out = found.join(nearest, "_dir", "left")
    return out.select(
        "doc_id", "path", "own_license", "score", "is_license_file",
        F.coalesce("own_license", "_near._granted").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("_near._at")).alias("inherited_from"),
    )
