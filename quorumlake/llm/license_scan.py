"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Words are lower-cased and stripped of marks at both ends; a text's shingles are its runs of five
words.  For a template of n distinct shingles the text is cut into windows of
``n + step`` shingles that start every ``step = ceil(n / 4)``, so an occurrence lies
wholly in one of them.  Windows and templates are compared by ``BANDS`` bands of
``ROWS`` MinHash values.  A template of which the share ``CONTAINED`` is found at least has a
Jaccard similarity of ``CONTAINED / (2.25 - CONTAINED)`` or more with its window, for which
``collision_probability`` is over 0.999; a test holds it to that.  A window without any
template's shingle can't agree in a band, so only windows that hold one are hashed.  What collides
is verified: the template's share of shingles inside the window and a step on either side.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, shingle_hashes

K = 5
BANDS, ROWS = 32, 2
CONTAINED = 0.8

# Wording of common licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

_MARKS = b"\"'()[]{}<>.,;:!?*_-/#|"


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """That two sets of this Jaccard similarity agree in at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def license_words(text: str | None) -> list[bytes]:
    return [w for x in (text or "").encode("utf-8", "replace").lower().split() if (w := x.strip(_MARKS))]


def min_hashes(values: np.ndarray) -> np.ndarray:
    return (values[:, None] * _FACTORS[None, :] + _OFFSETS[None, :]).min(0)


_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def band_keys(values: np.ndarray) -> list[bytes]:
    mins = min_hashes(values)
    return [bytes([b]) + mins[b * ROWS : (b + 1) * ROWS].tobytes() for b in range(BANDS)]


class TemplateIndex:
    """Bands of all templates by size; bounded by the list of templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        hashes = WordHashes()
        self.names = [name for name, _ in templates]
        found = [np.unique(shingle_hashes(hashes.of(license_words(t)), K), return_index=True) for _, t in templates]
        self.sets, self.orders = [x for x, _ in found], [at for _, at in found]
        short = [t for (_, t), s in zip(templates, self.sets, strict=True) if not len(s) or len(license_words(t)) < K]
        if short:
            raise ValueError(f"templates need at least {K} words: {short[0]!r}")
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.sizes: dict[int, dict[bytes, list[int]]] = {}
        for i, s in enumerate(self.sets):
            bands = self.sizes.setdefault(len(s), {})
            for key in band_keys(s):
                bands.setdefault(key, []).append(i)

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Places whose shingle is in some template."""
        if not len(self.all):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.all, values), len(self.all) - 1)
        return np.flatnonzero(self.all[at] == values)

    def scan(self, shingles: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, containment, first word, end word) of every occurrence of each template found."""
        hits = self.holds(shingles)
        regions: dict[int, list[tuple[int, int, float, int, int]]] = {}
        for size, bands in self.sizes.items() if len(hits) else ():
            step = -(-size // 4)
            width = size + step
            first, last = np.maximum(0, (hits - width) // step + 1), hits // step
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])) * step
            for start in starts.tolist():
                window = shingles[start : start + width]
                for t in {t for key in band_keys(window) for t in bands.get(key, ())}:
                    a = max(0, start - step)
                    around = shingles[a : start + width + step]
                    inside = np.isin(around, self.sets[t])
                    share = len(np.unique(around[inside])) / size
                    where = np.flatnonzero(inside)
                    if share >= CONTAINED:
                        regions.setdefault(t, []).append((a, a + len(around), share, a + int(where[0]), a + int(where[-1]) + K))
        return [(t, *x) for t in sorted(regions) for x in self.occurrences(shingles, t, sorted(regions[t]))]

    def occurrences(self, shingles: np.ndarray, t: int, regions: list[tuple[int, int, float, int, int]]) -> list[tuple[float, int, int]]:
        """(share, first word, end word) of the occurrences in verified regions (start, end, share, first word, end word), which don't overlap.

        An occurrence is a run of shingles in the template's order.  A region without one, as when words
        of the template stand in between, is an occurrence as a whole.
        """
        wanted, order = self.sets[t], self.orders[t]
        runs: list[list[int]] = []
        done, last = 0, -1
        for start, end, *_ in regions:
            part = shingles[max(start, done) : end]
            at = np.minimum(np.searchsorted(wanted, part), len(wanted) - 1)
            for i in np.flatnonzero(wanted[at] == part).tolist():
                place, now = max(start, done) + i, int(order[at[i]])
                if runs and now > last and place - runs[-1][0] < end - start:
                    runs[-1].append(place)
                else:
                    runs.append([place])
                last = now
            done = max(done, end)
        out: list[tuple[int, int, float]] = []
        for run in runs:
            if len(run) >= CONTAINED * len(wanted) and (not out or run[0] >= out[-1][1]):
                out.append((run[0], run[-1] + K, len(run) / len(wanted)))
        for _, _, share, first, end in sorted(regions, key=lambda x: (-x[2], x[0])):
            i = bisect(out, first, key=lambda x: x[0])
            if not (i and out[i - 1][1] > first or i < len(out) and out[i][0] < end):
                out.insert(i, (first, end, share))
        return [(share, first, end) for first, end, share in out]


FOUND = "doc_id long, license string, template int, containment double, first_word long, end_word long"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each occurrence of each template in each row of ``docs``; those of one template don't overlap.

    ``first_word`` and ``end_word`` count words from 0.  Null, empty and wordless texts, and
    texts of under five words, hold no template.  Whole texts are scanned; repeated rows give
    repeated results; an empty table or list of templates gives an empty table.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = license_words(text.as_py())
                if len(words) >= K:
                    rows += [(i, index.names[t], t, round(share, 6), a, b) for t, share, a, b in index.scan(shingle_hashes(hashes.of(words), K))]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)
