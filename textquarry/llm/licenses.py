"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Windows slide over all words of a text, across lines and paragraphs. A window begins and ends with a bigram of the
template it is compared with. For a Dice of t it must share at least t / (2 - t) of the template's distinct bigrams, and
it has at most (2 - t) / t as many bigrams as the template; all such windows are compared, from the starts behind which
enough shared bigrams stand. Of the windows of a template that overlap, the best one stays; of those of different
templates, the one that shares most bigrams claims them, and others stay if at most half of theirs are claimed.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

THRESHOLD = 0.8

# The wording of public licence notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


# The excerpts above stay beside the whole wordings.
for _name, _rest in {
    "BSD-2-Clause": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-3.0": "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
}.items():
    TEMPLATES[_name].append(TEMPLATES[_name][-1] + " " + _rest)


#: Whole public licences, a file each in license_texts, named by its identifier; they too are fixed values.
WHOLE = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0")


def _whole() -> None:
    """Adds the whole wordings, read as resources of the package, so that they come along in a zip too; one that is missing
    is an error, never a smaller set."""
    folder = resources.files(__package__).joinpath("license_texts")
    for name in WHOLE:
        try:
            text = folder.joinpath(f"{name}.txt").read_text(encoding="utf-8")
        except (FileNotFoundError, KeyError) as error:
            raise RuntimeError(f"the package lacks license_texts/{name}.txt") from error
        TEMPLATES.setdefault(name, []).append(text)


_whole()


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram hashes of consecutive words, the byte where each bigram starts and where it ends."""
    data = common.LOWER[data]
    starts, ends, _ = common.word_spans(data, offsets, common.ALNUM_BYTE)
    h = common.span_hashes(data, starts, ends)
    return common.gram_hashes(h, 2), starts[:-1], ends[1:]


class Templates:
    """Distinct bigram hashes of each wording (numbered over all of them), how many, and how many with repeats."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.names, grams, lengths = [], [], []
        for name, texts in sorted(templates.items()):
            for text in texts:
                data = np.frombuffer(text.encode(), np.uint8)
                g = _grams(data, np.array([0, data.size]))[0]
                if g.size:
                    self.names.append(name)
                    grams.append(np.unique(g))
                    lengths.append(g.size)
        self.sizes, self.lengths = np.array([g.size for g in grams], np.int64), np.array(lengths, np.int64)
        self.all = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.has = np.array([np.isin(self.all, g) for g in grams]).reshape(len(grams), self.all.size)


#: Cells of the table of windows that is made at once.
CELLS = 1 << 20


def _windows(hit: np.ndarray, before: np.ndarray, size: int, most: int, least: float, threshold: float) -> list[tuple[float, int, int, int]]:
    """(Dice, first bigram, last bigram, shared) of the best window from each start that reaches the threshold; hit
    marks the template's bigrams, before has the place of each bigram's previous occurrence (or -1)."""
    at = np.flatnonzero(hit)
    starts = at[np.searchsorted(at, at + most) - np.arange(at.size) >= least]
    step, out = max(1, CELLS // most), []
    for k in range(0, starts.size, step):
        first = starts[k : k + step, None]
        place = first + np.arange(most)
        inside = place < hit.size
        place = np.minimum(place, hit.size - 1)
        new, own = (before[place] < first) & inside, hit[place] & inside
        shared = np.cumsum(new & own, axis=1)
        dice = np.where(own, 2 * shared / (np.cumsum(new, axis=1) + size), 0.0)
        best = dice.argmax(axis=1)
        rows = np.arange(best.size)
        top = dice[rows, best]
        good = np.flatnonzero(top >= threshold)
        out += zip(top[good].tolist(), first[good, 0].tolist(), (first[good, 0] + best[good]).tolist(), shared[good, best[good]].tolist())
    return out


def scan_text(grams: np.ndarray, begin: np.ndarray, end: np.ndarray, number: np.ndarray, templates: Templates, threshold: float) -> list[tuple[int, int, str, float]]:
    """(start, end, licence, Dice) of the matching windows of one text; number is that of a bigram of any template, or -1."""
    least = templates.sizes * threshold / (2 - threshold) - 1e-9
    known = np.flatnonzero(number >= 0)
    possible = np.flatnonzero(templates.has[:, np.unique(number[known])].sum(axis=1) >= least)
    if not possible.size:
        return []
    order = np.argsort(grams, kind="stable")
    before = np.full(grams.size, -1)
    same = grams[order[1:]] == grams[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    found, hits = [], {}
    for t in possible.tolist():
        hit = hits[t] = np.zeros(grams.size, bool)
        hit[known] = templates.has[t, number[known]]
        most = int(templates.lengths[t] * (2 - threshold) / threshold + 1e-9)
        used = np.zeros(grams.size, bool)
        for dice, a, b, shared in sorted(_windows(hit, before, int(templates.sizes[t]), most, least[t], threshold), key=lambda w: (-w[0], w[1], w[2])):
            if not used[a : b + 1].any():
                used[a : b + 1] = True
                found.append((-shared, -dice, a, t, b))
    claimed, out = np.zeros(grams.size, bool), []
    for _, dice, a, t, b in sorted(found):
        own = hits[t][a : b + 1]
        if 2 * np.count_nonzero(claimed[a : b + 1] & own) <= np.count_nonzero(own):
            claimed[a : b + 1] |= own
            out.append((int(begin[a]), int(end[b]), templates.names[t], round(-dice, 6)))
    return out


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES, name: str = "license_matches") -> DataFrame:
    """docs with an array column of (start byte, end byte, license, dice), by position, of all matching windows.

    Null and empty texts, and texts of one word, match nothing; a very long text is scanned whole, as a block of its own;
    every row is scanned by itself, so repeated rows and ties need no care (equals take the first place, then the first
    licence by name); an empty table gives an empty one; other columns pass through, but for one of the new one's name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        known = shared.value
        for _, _, data, offsets in common.text_blocks(batch.column(batch.schema.names.index(text))):
            grams, begin, end = _grams(data, offsets)
            at = np.minimum(np.searchsorted(known.all, grams), max(0, known.all.size - 1))
            number = np.where(known.all[at] == grams, at, -1) if known.all.size else np.full(grams.size, -1)
            lo = np.searchsorted(begin, offsets)
            some = np.concatenate([[0], np.cumsum(number >= 0)])
            for d in range(offsets.size - 1):
                a, b = int(lo[d]), int(lo[d + 1])
                if some[a] == some[b]:
                    out.append([])
                    continue
                inside = slice(a, a + int(np.searchsorted(end[a:b], offsets[d + 1], "right")))
                found = scan_text(grams[inside], begin[inside] - offsets[d], end[inside] - offsets[d], number[inside], known, threshold)
                out.append([{"start": s, "end": e, "license": x, "dice": v} for s, e, x, v in sorted(found)])
        return [pa.array(out, arrow)]

    return common.append_columns(docs, [T.StructField(name, kind)], compute)


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted, comma-joined) and best_dice of all documents."""
    made = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    m = F.col("license_matches")
    return made.select("doc_id", F.size(m).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(m["license"])), ",").alias("licenses"), F.coalesce(F.array_max(m["dice"]), F.lit(0.0)).alias("best_dice"))


def brute_force(text: str | None, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[int, int, str, float]]:
    """The same matches by growing every window of every template bigram by bigram, for tests."""
    import re

    def grams(s: bytes) -> list[tuple[tuple[bytes, bytes], int, int]]:
        w = list(re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower()))
        return [((x[0], y[0]), x.start(), y.end()) for x, y in zip(w, w[1:])]

    own, found = grams((text or "").encode()), []
    wordings = [(name, [g for g, *_ in grams(t.encode())]) for name, texts in sorted(templates.items()) for t in texts]
    for t, (_, wording) in enumerate(wordings):
        known, best = set(wording), []
        if len(known & {g for g, *_ in own}) * (2 - threshold) < threshold * len(known) - 1e-6:
            continue  # not even the whole text has enough of it
        for a in range(len(own)):
            seen, top = set(), None
            for b in range(a, min(len(own), a + int(len(wording) * (2 - threshold) / threshold + 1e-9))) if own[a][0] in known else ():
                seen.add(own[b][0])
                dice = 2 * len(seen & known) / (len(seen) + len(known))
                if own[b][0] in known and dice >= threshold and (top is None or dice > -top[0]):
                    top = (-dice, a, b, len(seen & known))
            best += [top] if top else []
        used: set[int] = set()
        for dice, a, b, shared in sorted(best):
            if not used & set(range(a, b + 1)):
                used |= set(range(a, b + 1))
                found.append((-shared, dice, a, t, b))
    claimed: set[int] = set()
    out = []
    for _, dice, a, t, b in sorted(found):
        hits = {i for i in range(a, b + 1) if own[i][0] in wordings[t][1]}
        if 2 * len(hits & claimed) <= len(hits):
            claimed |= hits
            out.append((own[a][1], own[b][2], wordings[t][0], round(-dice, 6)))
    return sorted(out)
