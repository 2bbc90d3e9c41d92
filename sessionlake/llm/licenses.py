"""License notices and whole licenses in texts, found by MinHash bands over
overlapping windows.

For each length of template, windows of the text overlap so far that one of
them holds the whole of a notice wherever it begins.  All windows are hashed: the
minhashes of a window are the least of those of the blocks that it is made of,
so that each word n-gram is hashed once for all windows.  Bands of a window's
minhashes retrieve templates; the number of bands is what a window at the worst
alignment with the least accepted containment needs to collide with the target
probability.  A match is verified by exact containment: the share of the
template's distinct word n-grams that the window holds.

Templates are a dictionary, or a table of at most ``MAX_TEMPLATE_BYTES``, which
each task has whole; a larger table is refused.

Defined cases: words are runs of anything but ASCII white space, compared
without case and without what isn't an ASCII letter or digit at their ends, and
left out where nothing stays; a null, empty or blank text has no license; a
text of any length is scanned whole; a license is listed once however often it
occurs, and each place it has is a match; repeated rows are scanned one by one;
an empty table gives an empty result; other columns of the input are ignored.
Templates of fewer words than an n-gram are refused; of rows of a table of
templates with the same name the largest text counts, and rows with a null name
or text are left out.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, type_of

WORDS = 5
THRESHOLD = 0.8
TARGET = 0.9999
ROWS = 2

#: Bytes that a table of templates may have, and words that are scanned at a time.
MAX_TEMPLATE_BYTES = 16_000_000
SLICE_WORDS = 100_000

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Public license notices, and whole short licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": "Released under the MIT License.",
    "mit-permission": _MIT_GRANT,
    "mit-license": _MIT_GRANT + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause": f"{_BSD_2} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_RNG = np.random.default_rng(77)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = _RNG.integers(1 << 62, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
_OTHER = bytes(set(range(256)) - _KEEP)


def normal(word: bytes) -> bytes:
    return word.lower().strip(_OTHER)


def window_of(size: int) -> tuple[int, int]:
    """Window and stride, in n-grams, for templates of ``size`` n-grams."""
    stride = max(1, size // 4)
    return size + stride - 1, stride


def blocks_of(size: int) -> int:
    """Blocks of a stride's length that cover a window."""
    window, stride = window_of(size)
    return -(-window // stride)


def bands_for(size: int, threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """Bands with which the worst accepted window collides often enough."""
    held = math.ceil(threshold * size)
    worst = held / (blocks_of(size) * window_of(size)[1] + size - held)
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - min(worst**ROWS, 1 - 1e-9))))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def ngrams(h: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        out = out + h[k : k + len(out)] * _TURN[k]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


class Scanner:
    """Templates by their length, with the minhashes of each."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold, self.names = threshold, sorted(templates)
        self.sets: list[np.ndarray] = []
        by_size: dict[int, list[int]] = {}
        for i, name in enumerate(self.names):
            words = [w for w in map(normal, templates[name].encode().split()) if w]
            if len(words) < WORDS:
                raise ValueError(f"template {name} has fewer than {WORDS} words")
            self.sets.append(np.unique(ngrams(word_hashes(words))))
            by_size.setdefault(len(words) - WORDS + 1, []).append(i)
        self.known: dict[bytes, int] = {}  # 0: no word at all
        self.sizes = [(size, bands_for(size, threshold), members) for size, members in sorted(by_size.items())]
        count = ROWS * max((bands for _, bands, _ in self.sizes), default=0)
        rng = np.random.default_rng(78)
        self.a = rng.integers(1 << 31, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(1 << 32, size=count, dtype=np.uint32)
        self.wanted = [np.array([self.hashes(g, j).min() for j in range(count)]) for g in self.sets]

    def hashes(self, grams: np.ndarray, j: int) -> np.ndarray:
        return (grams >> np.uint64(32)).astype(np.uint32) * self.a[j] + self.b[j]

    def retrieve(self, grams: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template, the windows that share a band with it, as text and
        start; ``first`` and ``sizes`` are where each text's n-grams are."""
        layout = []
        for size, bands, members in self.sizes:
            stride = window_of(size)[1]
            blocks = -(-sizes // stride)
            of = np.repeat(np.arange(len(sizes)), blocks)
            place = (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * stride
            other = [of[t:] != of[:-t] for t in range(1, min(blocks_of(size), len(of)))]
            layout.append((bands, members, of, place, first[of] + place, other, np.zeros((len(members), len(of)), bool), np.ones((len(members), len(of)), bool)))
        low = grams >> np.uint64(32)
        low = low.astype(np.uint32)
        for j in range(len(self.a)):
            x = low * self.a[j] + self.b[j]
            for bands, members, _, _, starts, other, met, row in layout:
                if j >= bands * ROWS:
                    continue
                block = np.minimum.reduceat(x, starts)
                least = block.copy()
                for t, outside in enumerate(other, 1):
                    np.minimum(least[:-t], np.where(outside, np.uint32(0xFFFFFFFF), block[t:]), out=least[:-t])
                for k, i in enumerate(members):
                    row[k] &= least == self.wanted[i][j]
                if j % ROWS == ROWS - 1:  # the last of a band
                    met |= row
                    row[:] = True
        return {i: [(int(of[w]), int(place[w])) for w in np.flatnonzero(met[k])] for _, members, of, place, _, _, met, _ in layout for k, i in enumerate(members)}

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """``template, first word, words, containment`` of each match in each text."""
        import xxhash

        raw = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        known = self.known
        if len(known) > 600_000:  # bounds the memory, not the result
            known.clear()
        for w in set(chain.from_iterable(raw)).difference(known):
            plain = normal(w)
            known[w] = xxhash.xxh64_intdigest(plain) or 1 if plain else 0
        counts = np.array([len(r) for r in raw], int)
        h = np.fromiter(map(known.__getitem__, chain.from_iterable(raw)), np.uint64, int(counts.sum()))
        of = np.repeat(np.arange(len(raw)), counts)
        place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        word = h != 0
        h, of, place = h[word], of[word], place[word]
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        if len(h) < WORDS:
            return out
        inside = of[: len(h) - WORDS + 1] == of[WORDS - 1 :]
        grams, begins = ngrams(h)[inside], np.flatnonzero(inside)
        which, first, sizes = np.unique(of[begins], return_index=True, return_counts=True)
        if not len(which):
            return out
        for i, windows in self.retrieve(grams, first, sizes).items():
            spans: dict[int, list[tuple[int, int, float]]] = {}
            window = window_of(next(size for size, _, members in self.sizes if i in members))[0]
            for text, start in windows:
                part = grams[first[text] + start : first[text] + min(start + window, sizes[text])]
                held = np.isin(part, self.sets[i])
                share = len(np.unique(part[held])) / len(self.sets[i])
                if share >= self.threshold:
                    at = np.flatnonzero(held)
                    spans.setdefault(text, []).append((int(start + at[0]), int(start + at[-1]), share))
            for text, found in spans.items():
                for b, e, share in apart(found):
                    one, last = begins[first[text] + b], begins[first[text] + e] + WORDS - 1
                    out[which[text]].append((self.names[i], int(place[one]), int(place[last] - place[one] + 1), share))
        return [sorted(found, key=lambda m: (m[1], m[0])) for found in out]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        return self.scan_all([text])[0]


def apart(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of overlapping spans, which are one match, that with the largest share."""
    out: list[tuple[int, int, float]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            out[-1] = max(out[-1], span, key=lambda s: (s[2], -s[0]))
        else:
            out.append(span)
    return out


MATCH = "array<struct<license: string, first_word: int, n_words: int, containment: double>>"


def templates_of(table: DataFrame, name: str = "license", text: str = "text") -> dict[str, str]:
    """A table of templates as a dictionary; its size is checked before."""
    rows = need(table, name, text).toDF("name", "text").filter("name IS NOT NULL AND text IS NOT NULL").groupBy("name").agg(F.max("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("name") + F.octet_length("text"))).first()[0] or 0
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates have {size} bytes, of {MAX_TEMPLATE_BYTES} at most")
    return {r.name: r.text for r in rows.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, licenses, matches`` for each row: the sorted names of the templates
    that occur, and each place where one does."""
    templates = TEMPLATES if templates is None else templates_of(templates) if isinstance(templates, DataFrame) else templates
    given = docs.sparkSession.sparkContext.broadcast(templates)
    kind = type_of(docs, key).simpleString()
    match = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))

    def run(batches):
        scanner = Scanner(given.value, threshold)
        fields = ("license", "first_word", "n_words", "containment")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([len(t or "") for t in texts]) // (6 * SLICE_WORDS)
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1) if texts else []:
                matches = scanner.scan_all([texts[i] for i in part])
                names = [sorted({m[0] for m in found}) for found in matches]
                yield pa.record_batch(
                    [batch.column(0).slice(int(part[0]), len(part)), pa.array(names, pa.list_(pa.string())), pa.array([[dict(zip(fields, m)) for m in found] for found in matches], match)],
                    names=[key, "licenses", "matches"],
                )

    return need(docs, key, text).mapInArrow(run, f"`{key}` {kind}, licenses array<string>, matches {MATCH}")
