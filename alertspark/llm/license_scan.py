"""License scans: fingerprints pick candidates, alignment confirms them.

Every template's runs of three words are hashed and winnowed (the smallest of
each window of four is kept) into an inverted index: hash -> (template, place).
A text's runs of three words are looked up there. Hits of one template on
neighbouring diagonals are one candidate, which a banded local alignment of
the template with the words around it turns into matched words and a span. A
match must have its template's deciding words (name, version, BY/NC/SA/ND); of
templates that compete for a span the one with most matched words is reported.

Templates are a parameter of bounded size; the index is broadcast after a check
of that size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alertspark.llm.common import WordHasher, Words, alnum_words
from alertspark.llm.decontam import shingle_hashes
from alertspark.llm.license_texts import TEXTS

GRAM, WINDOW, BAND = 3, 4, 8
#: A template of so many words a hit needs as many hits; long ones share many phrases with other texts.
WORDS_PER_HIT = 200
#: Templates up to this length must show all their deciding words, each run with the word before it.
SHORT = 20
_DECIDING = re.compile(r"[0-9]+|by|nc|sa|nd|cc0|attribution|noncommercial|sharealike|noderivatives|noderivs|mit|bsd|isc|zlib|apache|gnu|general|lesser|affero|library|mozilla|boost|eclipse|clause|unlicense|domain|rights|reserved")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Templates that may be broadcast, in words.
MAX_TEMPLATE_WORDS = 1_000_000

# Public licence notices, as they are commonly written.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
}
TEMPLATES |= {f"{n}-notice": f"Released under the {t} License." for n, t in (("BSD", "BSD"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("ISC", "ISC"), ("Zlib", "zlib"))}
TEMPLATES |= {
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "CC0-1.0": "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
}
_GNU = {"GPL": ("program", "General"), "LGPL": ("library", "Lesser General"), "AGPL": ("program", "Affero General")}
for _n, _v in (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
    _what, _name = _GNU[_n]
    _id = f"{_n}-{_v if '.' in _v else _v + '.0'}"
    TEMPLATES.setdefault(f"{_id}-notice", f"This work is licensed under the GNU {_name} Public License, version {_v}.")
    TEMPLATES.setdefault(_id, f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version.")
for _v, _port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
    for _n, _name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        TEMPLATES[f"CC-{_n}-{_v}-notice"] = f"Licensed under CC {_n} {_v}."
        TEMPLATES[f"CC-{_n}-{_v}"] = f"This work is licensed under a Creative Commons {_name} {_v} {_port} License."
TEMPLATES |= TEXTS
#: Deciding words of longer templates; all must be in a match.
DECIDING = {_n: (f"GNU {_GNU[_n.split('-')[0]][1]} Public License", f"version {_n.split('-')[1].removesuffix('.0')}") for _n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
DECIDING |= {"MIT-grant": ("portions of the Software",), "Apache-2.0": ("Apache License, Version 2.0",), "MPL-2.0": ("Mozilla Public License, v. 2.0",)}


def band_of(words: int) -> int:
    """How far a match of a template may stray from its diagonal; always less than the template's length."""
    return max(1, min(BAND, words // 6), min(4 * BAND, words // 50))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of each window; of all hashes where there are too few."""
    if len(h) <= window:
        return np.arange(len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        hasher = WordHasher(alnum_words())
        hashes, owner, place = [], [], []
        self.deciding: list[list[list[int]]] = []
        for t, name in enumerate(self.names):
            h = next(hasher.batches(pa.array([templates[name]]))).hashes
            if len(h) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            self.words.append(h)
            phrases = DECIDING[name] if TEMPLATES.get(name) == templates[name] and name in DECIDING else _deciding(templates[name])
            self.deciding.append([next(hasher.batches(pa.array([x]))).hashes.tolist() for x in phrases])
            grams = shingle_hashes(h, GRAM)
            at = winnow(grams, WINDOW)
            hashes.append(grams[at])
            owner.append(np.full(len(at), t))
            place.append(at)
        order = np.argsort(all_hashes := np.concatenate(hashes), kind="stable")
        self.hashes, self.owner, self.place = all_hashes[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, some: Words) -> np.ndarray:
        """Places of the batch whose three words are a fingerprint and lie in one document."""
        grams = shingle_hashes(some.hashes, GRAM)
        at = np.flatnonzero(self.low[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        found = np.searchsorted(self.hashes, grams[at])
        at = at[self.hashes[np.minimum(found, len(self.hashes) - 1)] == grams[at]]
        doc = np.searchsorted(some.at, at, "right") - 1
        return at[at + GRAM <= some.at[doc + 1]]

    def candidates(self, h: np.ndarray, at: list[int]) -> list[tuple[int, int, int]]:
        """(template, first diagonal, last diagonal) of the groups of hits in one document; a diagonal is text place - template place."""
        diagonals: dict[int, list[tuple[int, int]]] = {}
        grams = shingle_hashes(h, GRAM)
        for p in at:
            a, b = np.searchsorted(self.hashes, grams[p], "left"), np.searchsorted(self.hashes, grams[p], "right")
            for k in range(a, b):
                diagonals.setdefault(int(self.owner[k]), []).append((p - int(self.place[k]), int(self.place[k])))
        out = []
        for t, ds in diagonals.items():
            band, need = band_of(len(self.words[t])), max(1, len(self.words[t]) // WORDS_PER_HIT)
            ds.sort()
            groups: list[list[tuple[int, int]]] = []
            for d in ds:
                if groups and d[0] - groups[-1][0][0] <= band:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            out += [(t, g[0][0], g[-1][0]) for g in groups if len(g) >= need and len({x for _, x in g}) >= need]
        return out


def _deciding(template: str) -> list[str]:
    """The runs of deciding words of a short template, each with the word before it."""
    words = [w.lower() for w in _WORD.findall(template)]
    if len(words) > SHORT:
        return []
    at = [i for i, w in enumerate(words) if _DECIDING.fullmatch(w)]
    starts = [i for i in at if i - 1 not in at]
    ends = [i + 1 for i in at if i + 1 not in at]
    return [" ".join(words[max(a - 1, 0) : b]) for a, b in zip(starts, ends)]


def most_matched(template: np.ndarray, text: np.ndarray, first: int, last: int) -> int:
    """No alignment within the band has more matched words: the template's words that the text has there at all."""
    band = band_of(len(template))
    at = np.arange(len(template))
    found = np.zeros(len(template), bool)
    for d in range(first - band, last + band + 1):
        a, b = max(0, -d), min(len(template), len(text) - d)
        if a < b:
            found[a:b] |= template[a:b] == text[at[a:b] + d]
    return int(found.sum())


def align(template: np.ndarray, text: np.ndarray, first: int, last: int) -> tuple[int, int, int]:
    """Best local alignment within the band around the diagonals: (matched words, first word, word after the last).

    A match scores 2, a mismatch or a gap -1; of equal scores the first in the text.
    """
    band = band_of(len(template))
    lo, width = first - band, last - first + 2 * band + 1
    best = (0, 0, 0, 0)  # score, matched, start, end
    row: list[tuple[int, int, int]] = [(0, 0, 0)] * width  # score, matched, start for each diagonal
    for i, w in enumerate(template.tolist()):
        new = []
        for k in range(width):
            j = i + lo + k
            if not 0 <= j < len(text):
                new.append((0, 0, j + 1))
                continue
            score, matched, start = row[k]
            if score <= 0:
                score, matched, start = 0, 0, j
            got = (score + 2, matched + 1, start) if int(text[j]) == w else (score - 1, matched, start)
            if k + 1 < width and row[k + 1][0] - 1 > got[0]:  # a template word without partner
                got = (row[k + 1][0] - 1, *row[k + 1][1:])
            if k and new[k - 1][0] - 1 > got[0]:  # a text word without partner
                got = (new[k - 1][0] - 1, *new[k - 1][1:])
            new.append(got)
            if got[0] > best[0]:
                best = (got[0], got[1], got[2], j + 1)
        row = new
    return best[1:]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence texts in every whole text.

    One row per input row: id, n_matches, licenses (names, sorted), coverage
    (the best), matches (template, coverage = matched words / template words,
    matched words, start and end in code points), by place. Of matches that
    compete for a span the best is reported. A null, empty or
    wordless text has none (coverage 0). Repeated rows give repeated results, a
    null id stays null, other columns are not read. No shuffle.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.split()) for t in templates.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    match = "struct<template: string, coverage: double, matched: long, start: long, end: long>"
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(f"n_matches long, licenses array<string>, coverage double, matches array<{match}>").fields])
    arrow = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        index, hasher = shared.value, WordHasher(alnum_words())
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for some in hasher.batches(batch.column(1), keep_text=True):
                at = index.hits(some)
                doc = np.searchsorted(some.at, at, "right") - 1
                for d in np.unique(doc).tolist():
                    a, b = int(some.at[d]), int(some.at[d + 1])
                    text = batch.column(1)[some.first + d].as_py()
                    found[some.first + d] = _matches(index, some.hashes[a:b], (at[doc == d] - a).tolist(), text, min_coverage)
            names = [sorted({m["template"] for m in f}) for f in found]
            best = [max((m["coverage"] for m in f), default=0.0) for f in found]
            cols = [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(best, pa.float64()), pa.array(found, arrow)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _matches(index: Index, h: np.ndarray, at: list[int], text: str, min_coverage: float) -> list[dict]:
    spans = None
    kept: list[tuple[int, int, int, int]] = []
    for t, first, last in index.candidates(h, at):
        least = min_coverage * len(index.words[t])
        if most_matched(index.words[t], h, first, last) < least:
            continue
        matched, start, end = align(index.words[t], h, first, last)
        if matched >= least and _decided(index.deciding[t], h[start:end].tolist()):
            kept.append((t, matched, start, end))
    kept.sort(key=lambda m: (-m[1], -m[1] / len(index.words[m[0]]), m[2], m[0]))
    out: list[tuple[int, int, int, int]] = []
    for m in kept:
        if not any(_compete(m, o) for o in out):
            out.append(m)
    said = []
    for t, matched, start, end in sorted(out, key=lambda m: (m[2], m[3], m[0])):
        spans = spans if spans is not None else _word_spans(text)
        said.append({"template": index.names[t], "coverage": matched / len(index.words[t]), "matched": matched, "start": spans[start][0], "end": spans[end - 1][1]})
    return said


def _compete(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    """Do two matches say what one span is? Those of one template when they overlap, others when half of the shorter one does."""
    shared = min(a[3], b[3]) - max(a[2], b[2])
    return shared > 0 and (a[0] == b[0] or 2 * shared > min(a[3] - a[2], b[3] - b[2]))


def _decided(phrases: list[list[int]], words: list[int]) -> bool:
    return all(any(words[i : i + len(x)] == x for i in range(len(words) - len(x) + 1)) for x in phrases)


def _word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word, in code points."""
    return [m.span() for m in _WORD.finditer(text)]
