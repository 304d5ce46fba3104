"""License scans: winnowed fingerprints, an inverted index, banded alignment.

Texts become words of letters, digits and inner dots. Of each window of `WINDOW`
consecutive shingles of `SHINGLE` words the smallest hash is a fingerprint, so a match of
SHINGLE + WINDOW - 1 words has one. Templates' shingles are the inverted index; a
document's fingerprints find (template, place) hits in it. Templates too short for that
promise are looked up at each shingle. Hits near one diagonal are a candidate, which a local alignment within a
band around the diagonal scores. Matches covering at least `min_coverage` of a
template are reported with their spans, if the span has all words of the template that belong to a
license's name or version; of overlapping ones the one with more matched words.

The index holds the templates of this file or those given; it is built on the driver
and sent to the tasks, so templates are bounded by `MAX_TEMPLATE_BYTES`; more raise ValueError. Documents
are read in one pass without a shuffle.

Defined results. Null or empty text has no match. Templates below SHINGLE words find
nothing. A long text is scanned whole. Repeated rows are reported each. Null ids are reported as null. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
WINDOW = 3
BAND = 6
MIN_COVERAGE = 0.75
MAX_TEMPLATE_BYTES = 16 << 20
BATCH_BYTES = 2 << 20

# Notices and texts as the licenses' publishers give them.
TEMPLATES = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    (
        "MIT",
        "text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "header",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "header",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "header",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    (
        "BSD-2-Clause",
        "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "notice", "All rights reserved."),
]

# Words of licenses' names; with versions they tell licenses of one wording apart.
_NAMES = {"mit", "apache", "mozilla", "gnu", "lesser", "affero", "cc"}
_VARIANT = re.compile(r"v?[0-9]+([.][0-9]+)*|attribution(-[a-z]+)*|by(-[a-z]+)+")

_EDGES = re.compile(r"^[^a-z0-9]+|[^a-z0-9]+$")


def _plain(word: str) -> str:
    """A lower-cased word without the marks at its ends."""
    return word if word.isalnum() else _EDGES.sub("", word)


def decisive(word: str) -> bool:
    """Whether a plain word belongs to a license's name or version."""
    return word in _NAMES or _VARIANT.fullmatch(word) is not None


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that hold the smallest hash (the last of equals) of a window; all windows of a short sequence are one."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(n - window + 1) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Local alignment with text position - template position within band of the diagonal.

    A match scores 2, a mismatch or gap -1. Returns matched words, start and end in text.
    """
    width = 2 * band + 1
    # Of each cell: score, matched words, start.
    prev = [(0, 0, -1)] * (width + 2)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        cur = [(0, 0, -1)] * (width + 2)
        for c in range(1, width + 1):
            j = i + diagonal + c - 1 - band
            if not 0 <= j < len(text):
                continue
            score, matched, start = prev[c]
            if text[j] == word:
                cell = (score + 2, matched + 1, start if score > 0 else j)
            else:
                cell = (score - 1, matched, start)
            up, left = prev[c + 1], cur[c - 1]
            cell = max(cell, (up[0] - 1, up[1], up[2]), (left[0] - 1, left[1], left[2]))
            if cell[0] > 0:
                cur[c] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        prev = cur
    return best[1], best[2], best[3]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        if sum(len(t[2].encode()) for t in templates) > MAX_TEMPLATE_BYTES:
            raise ValueError(f"more than {MAX_TEMPLATE_BYTES} bytes of templates; scan with a part of them at a time")
        self.names = [t[:2] for t in templates]
        self.number: dict[str, int] = {}
        self.texts: list[list[int]] = []
        self.decisive: list[set[int]] = []
        marks: list[tuple[int, int, int]] = []
        for n, (_, _, text) in enumerate(templates):
            words = [p for w in text.lower().split() if (p := _plain(w))]
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            self.texts.append(ids)
            self.decisive.append({i for i, w in zip(ids, words, strict=True) if decisive(w)})
            hashes = common.windows(np.array(ids, np.uint64), SHINGLE)
            # All shingles, so that any fingerprint of a document inside a match finds it.
            marks += [(int(h), n, i) for i, h in enumerate(hashes)]
        marks.sort()
        self.hashes = np.array([m[0] for m in marks], np.uint64)
        self.short = np.array([m[0] for m in marks if len(self.texts[m[1]]) < SHINGLE + WINDOW - 1], np.uint64)
        self.places = [m[1:] for m in marks]


_MATCHES = "doc_id long, license string, form string, matched_words int, template_words int, coverage double, span_start int, span_end int"


def _scan(index: Index, min_coverage: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in common.rebatch(batches, ["text"], BATCH_BYTES):
            tok = common.tokenize(rb.column("text"))
            # 0: nothing but marks, left out; -1: a word of no template.
            plain = (_plain(w) for w in tok.words.to_pylist())
            number = np.fromiter((index.number.get(p, -1) if p else 0 for p in plain), np.int64, len(tok.words))
            words = number[tok.ids] if len(tok.ids) else np.empty(0, np.int64)
            near = np.flatnonzero(words > 0)
            rows = []
            for d in np.unique(np.searchsorted(tok.starts, near, side="right") - 1).tolist():
                a, b = tok.starts[d], tok.starts[d + 1]
                place = np.flatnonzero(words[a:b])
                text = words[a:b][place]
                known = np.concatenate(([0], np.cumsum(text > 0)))
                if len(text) < SHINGLE or not (known[SHINGLE:] - known[:-SHINGLE] == SHINGLE).any():
                    continue
                # Shingles with a foreign word cannot match; their hash only fills the windows.
                hashes = common.windows(text.astype(np.uint64), SHINGLE)
                foreign = known[SHINGLE:] - known[:-SHINGLE] < SHINGLE
                hashes[foreign] = np.uint64(2**64 - 1)
                marks = np.union1d(winnow(hashes), np.flatnonzero(np.isin(hashes, index.short)))
                marks = marks[~foreign[marks]]
                rows += [(d, *m) for m in _matches(index, text.tolist(), hashes, marks, place, min_coverage)]
            if rows:
                docs = rb.column("doc_id").take(pa.array([r[0] for r in rows]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), *(pa.array(cols[i], pa.int32()) for i in (3, 4)), pa.array(cols[5], pa.float64()), *(pa.array(cols[i], pa.int32()) for i in (6, 7))],
                    names=[x.split()[0] for x in _MATCHES.split(", ")],
                )

    return run


def _matches(index: Index, text: list[int], hashes: np.ndarray, marks: np.ndarray, place: np.ndarray, min_coverage: float) -> list[tuple]:
    lo, hi = np.searchsorted(index.hashes, hashes[marks], "left"), np.searchsorted(index.hashes, hashes[marks], "right")
    hits: dict[int, list[int]] = {}
    for m, x, y in zip(marks.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for t, i in index.places[x:y]:
            hits.setdefault(t, []).append(m - i)
    found = []
    for t, diagonals in hits.items():
        diagonals.sort()
        start = 0
        for k in range(1, len(diagonals) + 1):
            if k == len(diagonals) or diagonals[k] - diagonals[start] > BAND:
                n, a, b = align(index.texts[t], text, (diagonals[start] + diagonals[k - 1]) // 2)
                if n >= min_coverage * len(index.texts[t]) and index.decisive[t] <= set(text[a:b]):
                    found.append((-n, a, b, t))
                start = k
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []
    for n, a, b, t in sorted(found):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            size = len(index.texts[t])
            out.append((*index.names[t], -n, size, -n / size, int(place[a]), int(place[b - 1]) + 1))
    return sorted(out, key=lambda m: m[5])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each match: doc_id, license, form, matched_words, template_words, coverage, span_start, span_end.

    Spans count the text's words [^\\x20\\x09-\\x0D]+, from 0, end excluded. templates: (license, form, text).
    """
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_scan(Index(TEMPLATES if templates is None else templates), min_coverage), _MATCHES)
