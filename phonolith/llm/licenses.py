"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

The templates' fingerprints form an inverted index of fixed size that goes out with the tasks; documents are scanned
where they lie, whole and without a shuffle. A run of at least GRAM + WINDOW - 1 words shared with a template has a
fingerprint in common with it, and only around such hits is anything aligned.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm.common import WORD, ngram_hashes, word_hashes

GRAM, WINDOW = 3, 3
#: Least share of a template's words that must be matched in order.
COVERAGE = 0.75

# License texts, and notices as their licenses word them.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
_BSD_NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEMPLATES = {
    "mit": _MIT_GRANT,
    "bsd-2-clause": f"{_BSD_TERMS} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD_TERMS} {_BSD_NO_ENDORSEMENT} {_BSD_WARRANTY}",
    "isc": _ISC,
    "zlib": _ZLIB,
    "mit-line": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of word runs that are least in some window of WINDOW runs (of all runs, if there are fewer)."""
    h = ngram_hashes(words, GRAM)
    if not len(h):
        return np.zeros(0, np.int64), h
    size = min(WINDOW, len(h))
    windows = np.lib.stride_tricks.sliding_window_view(h, size)
    least = windows.min(axis=1)
    chosen = np.zeros(len(h), bool)
    for i in range(size):
        chosen[i : i + len(least)] |= h[i : i + len(least)] == least
    at = np.flatnonzero(chosen)
    return at, h[at]


class Index:
    def __init__(self, templates: Mapping[str, str]):
        self.words = {name: word_hashes(text, strip=True) for name, text in templates.items()}
        places: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            for at, h in zip(*fingerprints(words), strict=True):
                places[int(h)].append((name, int(at)))
        self.places = dict(places)
        self.hashes = np.array(sorted(places), np.uint64)

    def hits(self, words: np.ndarray) -> Iterator[tuple[str, int]]:
        """(template, where in the text it would start) for each shared fingerprint."""
        at, h = fingerprints(words)
        if not len(h) or not len(self.hashes):
            return
        near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        for i in np.flatnonzero(self.hashes[near] == h):
            for name, place in self.places[int(h[i])]:
                yield name, int(at[i]) - place


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Most template words matched in order within `band` of the diagonal at `shift`, and the text's span of them.

    A longest-common-subsequence table over the band only, a row of it at a time; of equal counts the one whose first
    match is latest. A cell holds count, first and last match in one number, places counted from the band's first word.
    """
    width, base = 2 * band + 1, shift - band
    one, places = 1 << 40, (1 << 20) - 1
    near = np.zeros(len(template) + width - 1, np.uint64)  # text along the band; 0 outside of it
    lo, hi = max(0, base), min(len(text), base + len(near))
    inside = np.zeros(len(near), bool)
    if lo < hi:
        near[lo - base : hi - base], inside[lo - base : hi - base] = text[lo:hi], True
    best = np.zeros(width + 1, np.int64)
    for i, word in enumerate(template):
        at = np.arange(i, i + width)
        diagonal = best[:-1]
        longer = np.where(diagonal == 0, one | at << 20 | at, ((diagonal + one) & ~places) | at)
        match = inside[i : i + width] & (near[i : i + width] == word)
        best[:-1] = np.maximum.accumulate(np.maximum(best[1:], np.where(match, longer, 0)))
    top = int(best.max())
    return (top >> 40, base + (top >> 20 & places), base + (top & places)) if top else (0, -1, -1)


def scan(text: str | pa.Scalar | None, index: Index, coverage: float = COVERAGE) -> list[tuple]:
    """Matches in a text: license, first and last word, code-point start and end, words matched, words of the template."""
    words = word_hashes(text, strip=True)
    shifts: dict[str, set[int]] = defaultdict(set)
    for name, shift in index.hits(words):
        shifts[name].add(shift)
    found: dict[tuple[str, int], tuple] = {}
    for name, all_shifts in shifts.items():
        template = index.words[name]
        band = max(2, len(template) // 5)
        tried = None
        for shift in sorted(all_shifts):
            if tried is not None and shift - tried <= band // 2:
                continue  # the band of the last diagonal holds this one
            tried = shift
            matched, first, last = align(template, words, shift, band)
            if matched >= coverage * len(template):
                rival = found.get((name, last))
                if rival is None or rival[2] < matched:
                    found[name, last] = (first, last, matched, len(template))
    if not found:
        return []
    spans = [m.span() for m in re.finditer(WORD, text.as_py() if isinstance(text, pa.Scalar) else text)]
    return [(name, first, last, spans[first][0], spans[last][1], matched, size) for (name, _), (first, last, matched, size) in sorted(found.items())]


_COLUMNS = ("license", "first_word", "last_word", "start", "end", "matched", "template_words")


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, first_word, last_word, start, end, matched, template_words, coverage: one row per match.

    Start and end are code points, end exclusive. Words are compared without case of A-Z and without punctuation. Null
    and empty texts have no match; a null doc_id and repeated rows are rows like others; matches of several templates,
    or of one template in several places, are all reported. An empty table gives an empty result. Other columns are
    ignored.
    """
    index = Index(templates)
    kind = pa.list_(pa.struct([(_COLUMNS[0], pa.string()), *((c, pa.int64()) for c in _COLUMNS[1:])]))

    @F.arrow_udf(f"array<struct<license:string,{','.join(f'`{c}`:long' for c in _COLUMNS[1:])}>>")
    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(_COLUMNS, m, strict=True)) for m in scan(t, index)] for t in texts], kind)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(scanned(F.col("text").cast("string"))).alias("m"))
    return found.select("doc_id", "m.*").withColumn("coverage", F.col("matched") / F.col("template_words"))
