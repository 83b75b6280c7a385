"""License scan: MinHash bands over overlapping text windows retrieve templates; exact shingle containment verifies them.

Templates are classed by their number of five-word shingles (1, 2, 3-4, 5-8, ...).  A template of a class of up to L
shingles is in a text if some L consecutive shingles of the text hold ``percent`` of the template's.  The windows of a text
are 2 L shingles long and start at every L-th of its shingles, so any stretch of L lies in one window.  A window that
holds ``percent`` of a template's shingles has at least a known Jaccard similarity with it; the number of bands (one row
each) makes the chance that no band collides at most ``MISS``.  Minima are taken over blocks once and combined for the
larger classes.  Candidates are verified on full shingle sets: all stretches of L in the window are counted, so no false
match is reported, and what a text holds does not depend on the texts around it or on where in the text it lies.

Words are compared from their first letter or digit on, and words without one are left out: comment markers, opening quotes
and brackets of source code do not hide a license.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .work import table

WORDS, MISS = 5, 1e-6
#: Notices, headers and short whole texts of common licenses (fixed values).
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-disclaimer": 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def bands_for(least: int, window: int, percent: int) -> int:
    """Bands for templates of ``least`` shingles or more in windows of ``window`` shingles."""
    shared = -(-least * percent // 100)
    similarity = shared / (window + least - shared)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - similarity))) if similarity < 1 else 1


class Scanner:
    def __init__(self, templates: dict[str, str], percent: int = 80):
        self.percent, self.names = percent, sorted(templates)
        h, words = tokens.bare_hashes(pa.array([templates[n] for n in self.names], pa.string()))[:2]
        if len(self.names) and np.diff(words).min() < WORDS:
            raise ValueError(f"a template needs {WORDS} words")
        self.sizes = np.diff(words)
        self.sets = tokens.shingle_sets(h, words, WORDS)
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.classes.setdefault(max(0, (len(s) - 1).bit_length()), []).append(i)
        self.bands = {c: bands_for(min(len(self.sets[i]) for i in members), 2 << c, percent) for c, members in self.classes.items()}
        rng = np.random.default_rng(5)
        most = max(self.bands.values(), default=0)
        self.mul = rng.integers(0, 1 << 63, most, np.uint64) * np.uint64(2) + np.uint64(1)
        self.hits: dict[tuple[int, int], dict[int, list[int]]] = {}
        for c, members in self.classes.items():
            for b in range(self.bands[c]):
                least: dict[int, list[int]] = {}
                for i in members:
                    least.setdefault(int(self._hash(self.sets[i], b).min()), []).append(i)
                flags = np.zeros(1 << 16, bool)
                flags[[v >> 16 for v in least]] = True
                self.hits[c, b] = (least, flags)

    def _hash(self, shingles: np.ndarray, band: int) -> np.ndarray:
        return ((shingles * self.mul[band]) >> np.uint64(32)).astype(np.uint32)

    def find(self, h: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, word after the last, containment) of the best stretch of each template in each text."""
        runs, counts = tokens.chain(h, WORDS), np.maximum(np.diff(words) - (WORDS - 1), 0)
        if not counts.any() or not self.classes:
            return []
        # Each text begins at a multiple of the largest block, so all its blocks count from its own first shingle.
        top = max(self.classes)
        begins = np.concatenate([[0], np.cumsum(-(-counts >> top) << top)])
        n, doc = int(begins[-1]), np.repeat(np.arange(len(counts)), counts)
        own = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        from_, to = words[doc] + own, begins[doc] + own
        seen: set[tuple[int, int]] = set()
        for b in range(max(self.bands.values())):
            value = np.full(n, 0xFFFFFFFF, np.uint32)
            value[to] = self._hash(runs[from_], b)
            for c in range(top + 1):
                if c:
                    value = np.minimum(value[::2], value[1::2])
                if c not in self.classes or b >= self.bands[c]:
                    continue
                window = np.append(np.minimum(value[:-1], value[1:]), value[-1])
                ends = (begins[1:][counts > 0] >> c) - 1  # the last block of a text is a window by itself
                window[ends] = value[ends]
                least, flags = self.hits[c, b]
                for at in np.flatnonzero(flags[window >> np.uint32(16)]).tolist():
                    seen.update((i, at << c) for i in least.get(int(window[at]), ()))
        best: dict[tuple[int, int], tuple] = {}
        for i, at in sorted(seen):
            length = 1 << max(0, (len(self.sets[i]) - 1).bit_length())
            d = int(np.searchsorted(begins, at, "right")) - 1
            lo = int(at - begins[d])
            here = runs[words[d] + lo : words[d] + min(lo + 2 * length, int(counts[d]))]
            found = self._fullest(here, self.sets[i], length)
            if found and found[0] * 100 >= self.percent * len(self.sets[i]):
                found = (-found[0] / len(self.sets[i]), lo + found[1], lo + found[2] + WORDS)
                best[d, i] = min(best.get((d, i), found), found)
        return sorted((d, i, a, z, -s) for (d, i), (s, a, z) in best.items())

    @staticmethod
    def _fullest(here: np.ndarray, wanted: np.ndarray, length: int) -> tuple[int, int, int] | None:
        """(distinct shingles of ``wanted``, first of them, last of them) of the fullest ``length`` shingles in a row; of
        equal ones the first."""
        inside = np.flatnonzero(np.isin(here, wanted))
        if not len(inside):
            return None
        # An occurrence counts in the stretches that begin after the one before of the same shingle.
        order = np.lexsort((inside, here[inside]))
        before = np.full(len(inside), -1)
        same = here[inside[order[1:]]] == here[inside[order[:-1]]]
        before[order[1:][same]] = inside[order[:-1][same]]
        change = np.zeros(len(here) + 1, np.int64)
        np.add.at(change, np.maximum(before, inside - length) + 1, 1)
        np.add.at(change, inside + 1, -1)
        held = np.cumsum(change)[: max(1, len(here) - length + 1)]
        start = int(held.argmax())
        part = inside[(inside >= start) & (inside < start + length)]
        return int(held[start]), int(part[0]), int(part[-1])


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, license, first_word, end_word, containment: a row for each document row and template of
    which L shingles in a row hold ``percent`` of the distinct five-word shingles (L: their number, rounded up to a power of
    two); of several such stretches the fullest, then the one that begins first.  Wordings that differ by a word or two (the
    AGPL and GPL headers) are both reported; the containment tells them apart.

    Words fold A-Z and count from their first letter or digit on (beyond ASCII, all are letters); others are left out, but first_word and end_word are numbers among all words.  Texts of under five words (null, empty, blank) match nothing.  A null doc_id is reported as null;
    repeated rows are each reported.  A very long text is scanned whole, by itself; memory follows its number of words.
    Empty tables give empty results; other columns are not read.  Templates (a bounded,
    stated list, of five words or more each) go to all executors; a shorter one raises ValueError.
    """
    Scanner(templates, percent)

    def run(batches):
        scanner = Scanner(templates, percent)
        for whole in batches:
            for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(1)), 4 << 20):
                batch = whole.slice(lo, hi - lo)
                h, words, place = tokens.bare_hashes(batch.column(1))
                found = [(d, i, int(place[words[d] + a]), int(place[words[d] + z - 1]) + 1, s) for d, i, a, z, s in scanner.find(h, words)]
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([scanner.names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.float64())], names=["doc_id", "license", "first_word", "end_word", "containment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, first_word int, end_word int, containment double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template that a document holds, with its place and containment."""
    return license_scan(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_license_scan": op3_license_scan}
