"""License scans: winnowed fingerprints pick candidates, alignment decides.

Hashes of three words in a row are winnowed (the least of every two
neighbours is kept), for the templates and for the texts; templates of fewer
than SHORT words keep the hashes of all pairs of words, as fewer of their words
can be in a row.  With that every text that has LEAST_COVERAGE percent of a
template, word for word, shares a fingerprint with it.  Equal fingerprints
propose a template at a place, neighbouring proposals are one, and a banded
local alignment of the template's words with the words there reports how much
of it matches, and where.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkernel as tk
from tidelog.llm.common import bounded_batches, texts

#: Words of a fingerprint, and neighbours of which the least is kept.
GRAM, WINNOW = 3, 2
#: Templates of fewer words have fingerprints of two words, not winnowed.
SHORT, PAIR = 16, 2
#: Score of an equal word in an alignment.
EQUAL = 1 << 20
#: Matched words of a template, in percent, that make a match.
LEAST_COVERAGE = 80

# Public notices of common licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:"
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "GPL-2.0-or-later-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
        "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def _words(column: pa.Array):
    """Word hashes with the first byte and the end byte of each, by text."""
    data, at = tk.buffers(column)
    h, place, first = tk.words(data, at, tk.NOT_ALNUM)
    ends = np.flatnonzero(tk.NOT_ALNUM[data])
    stops = np.r_[ends, len(data)][np.searchsorted(ends, place)] if len(place) else place
    border = at[np.searchsorted(at, place, "right")] if len(place) else place
    return data, at, h, place, np.minimum(stops, border), first


def winnow(g: np.ndarray) -> np.ndarray:
    """Positions that are the least of some WINNOW neighbours, as a mask."""
    keep = np.zeros(len(g), dtype=bool)
    if len(g) <= WINNOW:
        if len(g):
            keep[int(np.argmin(g))] = True
        return keep
    windows = np.lib.stride_tricks.sliding_window_view(g, WINNOW)
    keep[np.arange(len(windows)) + windows.argmin(axis=1)] = True
    return keep


class Index:
    """Inverted indexes of the templates' fingerprints, by the words of a fingerprint."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        _, _, h, _, _, first = _words(pa.array([templates[n] for n in self.names], pa.string()))
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.band = np.maximum(2, self.sizes // 8)
        self.lists = {}
        for size in (PAIR, GRAM):
            rows = []
            for i, w in enumerate(self.words):
                if (len(w) < SHORT) == (size == PAIR):
                    g = tk.grams(w, size)
                    rows += [(int(g[p]), i, int(p)) for p in (range(len(g)) if size == PAIR else np.flatnonzero(winnow(g)))]
            rows.sort()
            self.lists[size] = tuple(np.array([r[j] for r in rows], dtype=kind) for j, kind in enumerate((np.uint64, np.int64, np.int64)))

    def proposals(self, h: np.ndarray, first: np.ndarray):
        """(text, template, starts): runs of neighbouring starts, in words of the text, by text and template."""
        found = []
        for size, (gram, template, place) in self.lists.items():
            g = tk.grams(h, size)
            lo, hi = np.searchsorted(gram, g, "left"), np.searchsorted(gram, g, "right")
            pos = np.flatnonzero(hi > lo)
            doc = np.searchsorted(first, pos, "right") - 1
            inside = pos + size <= first[doc + 1]
            pos, doc = pos[inside], doc[inside]
            if size == GRAM:  # those of the templates are few, so membership comes before winnowing
                kept = [_kept(g, p, first[d], first[d + 1] - size + 1) for p, d in zip(pos.tolist(), doc.tolist(), strict=True)]
                pos, doc = pos[kept], doc[kept]
            n = hi[pos] - lo[pos]
            pick = np.repeat(lo[pos] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(doc, n), template[pick], np.repeat(pos - first[doc], n) - place[pick]], axis=1))
        rows = np.unique(np.concatenate(found), axis=0)
        if not len(rows):
            return
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] - rows[:-1, 2] > self.band[rows[1:, 1]])
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
            yield int(rows[a, 0]), int(rows[a, 1]), rows[a:b, 2]

    def matches(self, text: np.ndarray, t: int, starts: np.ndarray):
        """(equal words, first, end) of the template's matches near some starts."""
        w, band = self.words[t], int(self.band[t])
        known, least = np.unique(w), LEAST_COVERAGE * len(w)
        todo = [starts]
        while todo:
            run = todo.pop()
            if run[-1] - run[0] > 8 * band:  # long runs of repeated words are taken in parts
                half = len(run) // 2
                todo += [run[half:], run[:half]]
                continue
            lo, hi = max(0, run[0] - band), min(len(text), run[-1] + len(w) + band)
            if 100 * np.isin(text[lo:hi], known).sum() < least:
                continue
            n, a, b = align(w, text, int(run[0] + run[-1]) // 2, band + int(run[-1] - run[0] + 1) // 2)
            if 100 * n >= least:
                yield n, a, b
                todo += [r for r in (run[run >= b - len(w) // 5], run[run + len(w) <= a + len(w) // 5]) if len(r) and len(r) < len(run)]


def align(template: np.ndarray, text: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Banded local alignment: (equal words, first, end) of the text's words.

    The band holds the diagonals within ``band`` of ``start``.  Substitutions
    and gaps cost one each and equal words outweigh any number of them, so no
    alignment in the band has more equal words.
    """
    width = 2 * band + 1
    score = np.zeros(width + 2)
    equal = np.zeros(width + 2, dtype=np.int64)
    begin = np.zeros(width + 2, dtype=np.int64)
    best = (0.0, 0, 0, 0)
    lane = np.arange(width)
    for i, w in enumerate(template):
        cols = start - band + i + lane
        real = (cols >= 0) & (cols < len(text))
        same = np.zeros(width, dtype=bool)
        same[real] = text[cols[real]] == w
        diag = score[1:-1] + np.where(same, EQUAL, -1)
        skip = score[2:] - 1  # a template word without partner
        new, eq, bg = diag, equal[1:-1] + same, np.where(score[1:-1] > 0, begin[1:-1], cols)
        use = skip > new
        new, eq, bg = np.where(use, skip, new), np.where(use, equal[2:], eq), np.where(use, begin[2:], bg)
        new = np.where(real, new, 0.0)
        # Text words without partner cost one each: the last of the best places before every one.
        level = new + lane
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level >= top, lane, 0))
        new, eq, bg = top - lane, eq[source], bg[source]
        dead = (new <= 0) | ~real
        new[dead], eq[dead] = 0.0, 0
        c = int(np.argmax(new))
        if new[c] > best[0]:
            best = (float(new[c]), int(eq[c]), int(bg[c]), int(cols[c]) + 1)
        score[1:-1], equal[1:-1], begin[1:-1] = new, eq, bg
    return best[1:]


def _code_points(data: np.ndarray, places: list[int]) -> dict[int, int]:
    """Code points before each of some bytes of a text, counted in one pass."""
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += int(np.count_nonzero((data[at:p] & 0xC0) != 0x80))
        out[p], at = n, p
    return out


def _scan(templates: dict[str, str]):
    def run(batches):
        index = Index(templates)
        for batch in batches:
            data, at, h, place, stop, first = _words(batch.column("text"))
            found: dict[int, list[tuple[int, int, int, int]]] = {}
            for d, t, starts in index.proposals(h, first):
                for n, a, b in index.matches(h[first[d] : first[d + 1]], t, starts):
                    found.setdefault(d, []).append((t, a, b, n))
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, own in found.items():
                spans, last = [], (None, 0)
                for t, a, b, n in sorted(own, key=lambda m: (m[0], m[1], -m[3])):
                    if last[0] == t and a < last[1]:
                        continue
                    last = (t, b)
                    spans.append((t, n, int(place[first[d] + a] - at[d]), int(stop[first[d] + b - 1] - at[d])))
                points = _code_points(data[at[d] : at[d + 1]], [x for s in spans for x in s[2:]])
                rows[d] = [{"license": index.names[t], "coverage": round(n / len(index.words[t]), 6), "start": points[x], "end": points[y]} for t, n, x, y in spans]
                rows[d].sort(key=lambda m: (m["start"], m["license"]))
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "matches"])

    return run


def _kept(g: np.ndarray, p: int, lo: int, hi: int) -> bool:
    """Whether winnowing the text whose grams are g[lo:hi] keeps position p."""
    a, b = max(int(lo), p - WINNOW + 1), min(int(hi), p + WINNOW)
    return bool(winnow(g[a:b])[p - a]) if b - a > WINNOW else True


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, matches) for every row.

    ``matches`` lists (license, coverage, start, end) by start: the share of
    the template's words that match and the span in code points.  Words are
    compared without case and punctuation.  Null and empty texts, and
    templates of fewer than two words, match nothing; repeated rows and
    null ids stay; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = "array<struct<license:string,coverage:double,start:int,end:int>>"
    return texts(docs, id_col, text_col).mapInArrow(_scan(templates or TEMPLATES), f"doc_id bigint, matches {kind}")


def matches_text(matches):
    """license:start:end:coverage, comma-joined."""
    return F.array_join(F.transform(matches, lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.format_number(m["coverage"], 4))), ",")
