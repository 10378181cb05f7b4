"""Licence scans: counts of shared words pick windows, alignment reports coverage and spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textkernel import ALNUM, Words, buffers, lean, slices

#: Well-known public notices (fixed values).
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: An alignment spans fewer than SPAN words a word of its template: a longer one scores less than its last word alone.
SPAN = 4
#: Words that are aligned at a time.
PART = 1 << 17
OUT = "id long, license string, coverage double, matched int, start_word long, end_word long, start long, end long"


class TemplateIndex:
    """Words of the templates, numbered, and how often each template has them."""

    def __init__(self, templates: dict[str, str], least: float):
        self.names = list(templates)
        column = pa.array([templates[n] for n in self.names], pa.string())
        words = Words(*buffers(column), lower=True, in_word=ALNUM)
        self.keys = np.unique(words.hash)
        numbers = np.searchsorted(self.keys, words.hash)
        self.words = [numbers[words.first[i] : words.first[i + 1]] for i in range(len(self.names))]
        #: The least number of matched words that counts.
        self.need = [next((c for c in range(1, len(w) + 1) if c >= least * len(w)), len(w) + 1) for w in self.words]
        #: How often each template has each word.
        self.often = [np.bincount(w, minlength=len(self.keys)) for w in self.words]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 where no template has the word."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        slot = np.searchsorted(self.keys, hashes).astype(np.int32)
        slot[slot == len(self.keys)] = 0
        return np.where(self.keys[slot] == hashes, slot, np.int32(-1))


def align(template: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best alignments of the whole template that end at each word of the text.

    A match scores 2, a mismatch, a missing and an inserted word -1 each; the text's
    ends are free.  Of equal scores, more matched words, then the later start.
    Returns last + 1, score, matched words and first of the ends where a word matches.
    """
    m, n = len(template), len(text)
    low_bits, mid_bits = n.bit_length(), m.bit_length()
    if low_bits + mid_bits + (n + 4 * m).bit_length() > 62:
        raise ValueError("text and template are too long to align")
    # one number holds score, matched words and first, in this order
    unit, count = 1 << (low_bits + mid_bits), 1 << low_bits
    slope = np.arange(n + 1) * unit
    none = np.iinfo(np.int64).min
    ends = np.full(n, none)
    row = np.zeros(n + 1, np.int64)
    for i, w in enumerate(template.tolist()):
        at = np.flatnonzero(text == w)
        old = row[at]
        hit = old + (2 * unit + count) + np.where(old & (unit - count), 0, at)
        ends[at] = np.maximum(ends[at], hit - (m - 1 - i) * unit)
        new = row.copy()
        np.maximum(new[1:], row[:-1], out=new[1:])
        new -= unit
        new[at + 1] = np.maximum(new[at + 1], hit)
        new += slope
        np.maximum.accumulate(new, out=new)
        new -= slope
        row = new
    at = np.flatnonzero(ends != none)
    ends = ends[at]
    return at + 1, ends >> (low_bits + mid_bits), (ends & (unit - 1)) >> low_bits, ends & (count - 1)


def windows(index: TemplateIndex, ids: np.ndarray, owner: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(template, places of the words wherever it may match), a gap of -1 after each run, in parts of bounded size.

    A match needs `need` words of its template, none more often than there, in its
    text, and as many within SPAN words a word from its first; nothing else is asked.
    """
    known = np.flatnonzero(ids >= 0)
    stretch, word = owner[known], ids[known].astype(np.int64)
    pairs, count = np.unique(stretch * len(index.keys) + word, return_counts=True)
    of, which = np.divmod(pairs, max(1, len(index.keys)))
    for t, template in enumerate(index.words):
        need, reach = index.need[t], SPAN * len(template)
        shared = np.minimum(count, index.often[t][which])
        enough = np.bincount(of, weights=shared, minlength=len(first) - 1) >= need
        if not len(template) or not enough.any():
            continue
        places = known[enough[stretch] & (index.often[t][word] > 0)]
        starts, ends = places[: len(places) - need + 1], places[need - 1 :]
        starts = starts[(ends - starts < reach) & (owner[starts] == owner[ends])]
        for part in runs(starts - reach, starts + reach, owner[starts], first, reach):
            yield t, part


def runs(low: np.ndarray, high: np.ndarray, owner: np.ndarray, first: np.ndarray, gap: int) -> Iterator[np.ndarray]:
    """Joined ranges low .. high within their stretches, as places with a gap of -1 after each range."""
    low, high = np.maximum(low, first[owner]), np.minimum(high, first[owner + 1])
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] > high[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    low, high = low[head], high[np.append(head[1:], len(high)) - 1] if len(head) else high
    part, size = [], 0
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        part += [np.arange(a, b), np.full(gap, -1)]
        size += b - a + gap
        if size > PART:
            yield np.concatenate(part)
            part, size = [], 0
    if part:
        yield np.concatenate(part)


def candidates(index: TemplateIndex, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (stretch, template, matched, score, first, last + 1), for each end the best alignment, if it covers enough."""
    first = np.searchsorted(owner, np.arange(int(owner[-1]) + 2 if len(owner) else 1))
    found = [np.empty((0, 6), np.int64)]
    for t, places in windows(index, ids, owner, first):
        last, score, matched, begin = align(index.words[t], np.where(places >= 0, ids[places], -1))
        keep = matched >= index.need[t]
        begin, last = places[begin[keep]], places[last[keep] - 1] + 1
        found.append(np.stack([owner[begin], np.full(len(begin), t), matched[keep], score[keep], begin, last], axis=1))
    return np.concatenate(found)


def find(index: TemplateIndex, hashes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Matches (template, matched, first, last + 1) in texts; of any that overlap the better.

    What lies between the matches of one round is a text of its own in the next, until none is found.
    """
    sizes = np.array([len(w) for w in index.words])
    ids = index.number(hashes)
    place = np.arange(len(ids))
    matches: list[tuple[int, int, int, int]] = []
    while len(place):
        found = candidates(index, ids[place], owner)
        taken = np.zeros(len(place), bool)
        hit = np.zeros(int(owner[-1]) + 1, bool)
        o, t, matched, score, begin, last = found.T
        order = np.lexsort((begin, t, -score, -matched / sizes[t], -matched, o))
        for k in order.tolist():
            a, b = int(begin[k]), int(last[k])
            if not taken[a:b].any():
                taken[a:b] = True
                hit[o[k]] = True
                matches.append((int(t[k]), int(matched[k]), int(place[a]), int(place[b - 1]) + 1))
        rest = np.flatnonzero(~taken & hit[owner])
        cut = np.ones(len(rest), bool)
        cut[1:] = (np.diff(rest) > 1) | (np.diff(owner[rest]) > 0)
        owner, place = np.cumsum(cut) - 1, place[rest]
    return sorted(matches, key=lambda m: m[2])


def _scanner(templates: dict[str, str], least: float):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, least)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, offsets = buffers(batch.column(1).slice(a, b - a))
                words = Words(data, offsets, lower=True, in_word=ALNUM)
                rows = []
                matches = find(index, words.hash, words.doc)
                chars = np.cumsum((data & 0xC0) != 0x80) if matches else None
                for t, count, s, e in matches:
                    i = int(words.doc[s])
                    first = int(words.first[i])
                    base = int(chars[offsets[i] - 1]) if offsets[i] else 0
                    low, high = (int(chars[x - 1]) - base if x else 0 for x in (words.start[s], words.end[e - 1]))
                    rows.append((i, index.names[t], count / len(index.words[t]), count, s - first, e - first, low, high))
                ids = batch.column(0).slice(a, b - a).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[c.split()[0] for c in OUT.split(", ")])

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per match: (id, license, coverage, matched, start_word, end_word, start, end).

    Words are runs of letters and digits, A-Z lower-cased.  A match is the best
    alignment of a whole template that ends at some word of the text (a matched word
    scores 2; a changed, a missing and an inserted one -1 each), if its matched words
    are at least `least` of the template (coverage); its span is given in words and
    characters.  No such match is missed: only stretches without enough of the
    template's words are passed over.  Of overlapping matches the one with the most
    matched words is reported, and what lies between matches is searched again, so
    that each of several copies in a row has its own.

    Null and empty texts have no matches.  Null ids are kept; repeated rows are
    reported each; an empty table gives an empty result.  Whole texts count; other
    columns are not read.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scanner(templates or TEMPLATES, least), OUT)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
