"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Words are runs of letters and digits in lower case; a shingle is ``SHINGLE`` words in a row (all of them, where there are
fewer). Templates stand in classes by size, each class at most ``ratio`` wide. A text's windows for a class have the
size of its largest template plus one stride less one, and start at every stride, a quarter of that template: so any place
where a template may stand lies whole in some window. A window that holds ``least`` of a template's shingles then
has at least a known Jaccard with it; from that, ``bands_for`` takes the number of bands of ``rows`` MinHash values
which makes a miss less likely than ``miss``. Every window that shares a shingle with the class's templates is hashed; one that
shares none can't collide but by chance.

Candidates are verified on the shingles themselves. One pass, no shuffle; the templates are a parameter of fixed size.

Defined cases: a null or empty text, or one without words, has no matches; very long texts are read whole; matches of a
template in windows that overlap are one row, a later copy of it is a row of its own; all templates that a place
matches are given; repeated rows give equal rows; an empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mix, pieces, runs, table, word_hashes

SHINGLE = 3
#: Notices by which licenses are granted; a parameter of ``scan``.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}
SCHEMA = "license string, start int, end int, containment double"


def bands_for(jaccard: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` values of which one agrees with a probability of at least 1 - ``miss`` at this Jaccard."""
    p = jaccard**rows
    return 1 if p >= 1 else math.ceil(math.log(miss) / math.log1p(-p))


def shingles(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' shingles in order: hash, text, first and end character in it."""
    cp, starts = joined(texts)
    cp = table("lower")[cp]
    begin, end = runs(table("alnum")[cp])
    doc = np.searchsorted(starts, begin, side="right") - 1
    h = word_hashes(cp, begin, end)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    size = np.where(count, np.maximum(count - n + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), size)
    place = first[of] + np.arange(len(of)) - (np.cumsum(size) - size)[of]
    stop = (first + count)[of]
    out = np.zeros(len(of), dtype=np.uint64)
    for i in range(n):
        inside = place + i < stop
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[(place + i)[inside]])
    last = np.minimum(place + n, stop) - 1
    return out, of, begin[place] - starts[of], end[last] - starts[of]


class Index:
    """Templates in classes by size, with the band tables of each."""

    def __init__(self, templates: Mapping[str, str], least: float = 0.8, ratio: float = 1.35, rows: int = 2, miss: float = 1e-4):
        self.least, self.rows = least, rows
        self.names = sorted(templates)
        sets = []
        for name in self.names:
            h, _, _, _ = shingles([templates[name]])
            if not len(h):
                raise ValueError(f"template {name} has no words")
            sets.append(np.unique(h))
        self.sets = sets
        self.every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
        #: which of all shingles each template has
        self.of = np.array([np.isin(self.every, s) for s in sets]).reshape(len(sets), len(self.every))
        self.flag = np.zeros(1 << 20, dtype=bool)
        self.flag[(self.every >> np.uint64(44)).astype(np.int64)] = True
        self.classes = []
        left = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        while left:
            members = [i for i in left if len(sets[i]) <= len(sets[left[0]]) * ratio]
            left = left[len(members) :]
            high = len(sets[members[-1]])
            stride = max(1, high // 4)
            # words of the window: a template's shingles are at most as many as its places
            window = max(len(shingles([templates[self.names[i]]])[0]) for i in members) + stride - 1
            worst = min(least * len(sets[i]) / (window + (1 - least) * len(sets[i])) for i in members)
            bands = bands_for(worst, rows, miss)
            salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            keys: dict[int, list[int]] = {}
            for i in members:
                for k in self._keys(np.min(mix(sets[i][:, None] ^ salt[None]), axis=0)[None])[0].tolist():
                    keys.setdefault(k, []).append(i)
            known = np.array(sorted(keys), dtype=np.uint64)
            member = np.isin(self.every, np.concatenate([sets[i] for i in members]))
            self.classes.append((members, window, stride, salt, keys, known, member))

    def _keys(self, values: np.ndarray) -> np.ndarray:
        """Band keys (windows, bands) of MinHash values (windows, bands * rows)."""
        v = values.reshape(len(values), -1, self.rows)
        out = np.arange(v.shape[1], dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        for r in range(self.rows):
            out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + v[:, :, r])
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, str, int, int, float]]:
        """(text, license, start, end, containment) of all matches."""
        h, doc, begin, end = shingles(texts)
        near = np.flatnonzero(self.flag[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.every, h[near])
        at = np.minimum(at, len(self.every) - 1)
        real = self.every[at] == h[near] if len(self.every) else np.zeros(0, dtype=bool)
        hit, which = near[real], at[real]
        if not len(hit):
            return []
        count = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(count) - count
        out: list[tuple[int, str, int, int, float]] = []
        for members, window, stride, salt, keys, known, member in self.classes:
            mine = member[which]
            p, w = hit[mine], which[mine]
            if not len(p):
                continue
            rel = p - first[doc[p]]
            low = np.maximum(0, (rel - window) // stride + 1)
            n = rel // stride - low + 1
            # pairs of window and hit, in order of window
            pair = np.repeat(np.arange(len(p)), n)
            number = low[pair] + np.arange(len(pair)) - (np.cumsum(n) - n)[pair]
            key = (doc[p][pair].astype(np.int64) << 36) | number
            order = np.argsort(key, kind="stable")
            key, pair = key[order], pair[order]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate([head, [len(key)]]))
            found: dict[tuple[int, int], list[tuple[int, int, int, float]]] = {}
            for a in range(0, len(head), 4096):
                hd, sz = head[a : a + 4096], size[a : a + 4096]
                d, j = key[hd] >> 36, key[hd] & ((1 << 36) - 1)
                start = first[d] + j * stride
                stop = np.minimum(start + window, first[d] + count[d])
                value = np.full((len(hd), len(salt)), np.iinfo(np.uint64).max, dtype=np.uint64)
                for i in range(window):
                    inside = np.flatnonzero(start + i < stop)
                    if not len(inside):
                        break
                    value[inside] = np.minimum(value[inside], mix(h[start[inside] + i][:, None] ^ salt[None]))
                band = self._keys(value)
                place = np.minimum(np.searchsorted(known, band), len(known) - 1)
                for r in np.flatnonzero((known[place] == band).any(1)).tolist():
                    hits = pair[hd[r] : hd[r] + sz[r]]
                    for t in {t for k in band[r][known[place[r]] == band[r]].tolist() for t in keys[k]}:
                        own = hits[self.of[t][w[hits]]]
                        share = len(np.unique(w[own])) / len(self.sets[t])
                        if share >= self.least - 1e-9:
                            q = p[own]
                            found.setdefault((int(d[r]), t), []).append((int(j[r]), int(q.min()), int(q.max()), share))
            for (d, t), rows in found.items():
                rows.sort()
                i = 0
                while i < len(rows):
                    k = i + 1
                    while k < len(rows) and rows[k][0] * stride < rows[k - 1][0] * stride + window and rows[k][1] <= max(x[2] for x in rows[i:k]):
                        k += 1
                    some = rows[i:k]
                    a, b = min(x[1] for x in some), max(x[2] for x in some)
                    out.append((d, self.names[t], int(begin[a]), int(end[b]), round(max(x[3] for x in some), 6)))
                    i = k
        return sorted(out)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", least: float = 0.8, ratio: float = 1.35, rows: int = 2, miss: float = 1e-4) -> DataFrame:
    """(key, license, start, end, containment): where templates stand in the texts, in characters."""
    index = Index(templates, least, ratio, rows, miss)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "__text"):
            found = index.matches(pdf["__text"].tolist())
            if found:
                d, name, start, end, share = zip(*found)
                yield pd.DataFrame({"__key": pdf["__key"].to_numpy()[list(d)], "license": name, "start": start, "end": end, "containment": share})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInPandas(work, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)
