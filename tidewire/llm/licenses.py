"""Licence scans: a generalised suffix automaton of licence words, matching statistics, and chains of long matches.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. A text is streamed through the automaton of
all templates and phrases; at each word it holds the longest stretch ending there that occurs in any of them. A phrase ends
at a word if its state lies on the suffix path of the word's state. Matches that can't be extended and have `MIN_MATCH`
words or more are chained, in order of text and template and with bounded gaps, into spans; a template covered to
`MIN_COVER` of its words gives its label. Chains are cut from one table, the best first, so the work grows with the text however
often licences repeat. The score is the largest covered share of any template or phrase.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows get a row each; an empty table gives
none. Other columns aren't looked at. A text of any length is read once, in memory for its words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words
from .shingles import slices

#: Fixed values of the contract: phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening or operative parts of well-known licences, and whole texts of short ones; the label is what stands before a slash.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mit/whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd/whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc/whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib/whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense/whole": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
MIN_MATCH, MIN_COVER, MAX_GAP = 4, 0.5, 40


class SuffixAutomaton:
    """Of several sequences; holds for each state its length, suffix link and one end (sequence, place) of each occurrence."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, x in enumerate(seq):
                last = self._extend(last, x)
                self.ends[last].add((k, i))
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """The state of q's stretches up to one word longer than p's; q itself where that is all."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(x) == q:
            self.step[p][x] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, x: int) -> int:
        if x in self.step[last]:  # another sequence has been here
            return self._split(last, self.step[last][x], x)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and x not in self.step[p]:
            self.step[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.step[p][x], x)
        return new

    def state(self, seq: list[int]) -> int:
        s = 0
        for x in seq:
            s = self.step[s][x]
        return s


class Chains:
    """Chains of a template's matches (start, end, end in the template), which begin and end in rising order.

    Matches chain in order of text and template, no further apart than MAX_GAP words in either. A table holds for each match
    the words that the best chain ending there covers, and that chain's first match. The best chain of the table is cut
    from the text; matches that overlap it go, and no other chain passes over it. So only entries behind it can change, as far
    as a chain of lost matches reached. A match looks back MAX_GAP words, and a chain has no more matches than its template
    has words: the work grows with the matches, however many chains there are.
    """

    def __init__(self, found: list[tuple[int, int, int]]):
        self.found = found
        self.starts, self.ends = [a for a, _, _ in found], [b for _, b, _ in found]
        self.low = [bisect_left(self.ends, a - MAX_GAP) for a in self.starts]
        self.best: list[tuple[int, int] | None] = [None] * len(found)
        self.gone = bytearray(len(found))
        self.heap: list[tuple[int, int]] = []

    def fill(self, base: int) -> None:
        """Entries from base on, where matches before base are out of reach, until nothing that changed is in reach."""
        found, best, changed = self.found, self.best, base
        for i in range(base, len(found)):
            if self.gone[i] or (best[i] is not None and self.low[i] >= changed):
                return
            a, b, at = found[i]
            begin = at - (b - a)
            top, first = b - a, i
            for j in range(max(self.low[i], base), i):
                pa_, pb, pat = found[j]
                if pa_ < a and begin - pat <= MAX_GAP:
                    words_ = best[j][0] + min(b - max(a, pb), at - max(begin, pat))
                    if words_ > top and b > pb and at > pat:
                        top, first = words_, best[j][1]
            if (top, first) != best[i]:
                if best[i] is None or best[i][0] != top:
                    heappush(self.heap, (-top, i))
                best[i], changed = (top, first), i + 1

    def cut(self) -> Iterator[tuple[int, int, int]]:
        """Words covered, start and end of the best chain, then of the best of what is left, to the last."""
        self.fill(0)
        while self.heap:
            cover, i = heappop(self.heap)
            if self.gone[i] or self.best[i][0] != -cover:
                continue
            start, end = self.starts[self.best[i][1]], self.ends[i]
            yield -cover, start, end
            low, high = bisect_right(self.ends, start), bisect_left(self.starts, end)
            self.gone[low:high] = b"\1" * (high - low)
            self.fill(high)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        texts = [*templates.values(), *phrases]
        seqs = [words(t.encode()) for t in texts]
        self.number = {w: k for k, w in enumerate(sorted({w for s in seqs for w in s}))}
        coded = [[self.number[w] for w in s] for s in seqs]
        #: Words that a run of known words must have to hold a phrase or a match.
        self.least = min([MIN_MATCH, *(len(c) for c in coded[len(templates) :])])
        self.labels, self.sizes = [*templates], [len(s) for s in coded[: len(templates)]]
        self.auto = SuffixAutomaton(coded)
        found = {self.auto.state(c): (len(c), label) for c, label in zip(coded[len(templates) :], phrases.values())}
        #: For each state, the phrases that end where it does.
        self.phrases: list[list[tuple[int, str]]] = []
        for s in range(len(self.auto.size)):
            here, p = [], s
            while p > 0:
                if p in found:
                    here.append(found[p])
                p = self.auto.link[p]
            self.phrases.append(here)

    def matches(self, ids: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(start, label) of each phrase; (start, end, state) of each match that can't be extended, MIN_MATCH words or more."""
        step, link, size, phrases = self.auto.step, self.auto.link, self.auto.size, self.phrases
        places, long = [], []
        known = np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]]))
        begins, ends = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
        several = ends - begins >= self.least
        for a, b in zip(begins[several].tolist(), ends[several].tolist()):
            s = n = 0
            for j, x in enumerate(ids[a:b].tolist(), a):
                if x in step[s]:
                    s, n = step[s][x], n + 1
                else:
                    if n >= MIN_MATCH:
                        long.append((j - n, j, s))
                    while s > 0 and x not in step[s]:
                        s = link[s]
                    n = size[s]
                    if x in step[s]:
                        s, n = step[s][x], n + 1
                    else:
                        n = 0
                for k, label in phrases[s]:
                    if k <= n:
                        places.append((j + 1 - k, label))
            if n >= MIN_MATCH:
                long.append((b - n, b, s))
        return places, long

    def chains(self, long: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of each template, no two of one template over the same words."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for a, b, s in long:
            for k, end in sorted(self.auto.ends[s]):
                if k < len(self.labels):
                    by.setdefault(k, []).append((a, b, end + 1))
        out = []
        for k, found in by.items():
            for cover, start, end in Chains(found).cut():
                out.append({"label": self.labels[k].split("/")[0], "start": start, "end": end, "cover": min(1.0, cover / self.sizes[k]), "template": self.labels[k]})
        return sorted(out, key=lambda x: (-x["cover"], x["start"], x["template"]))

    def scan(self, text: bytes) -> dict:
        w = words(text)
        ids = np.fromiter(map(self.number.get, w, repeat(-1)), np.int64, len(w))
        places, long = self.matches(ids)
        spans = self.chains(long) if long else []
        base = sorted({x for _, x in places})
        own = {x["label"] for x in spans if x["cover"] >= MIN_COVER}
        starts = [a for a, _ in places]
        score = 1.0 if places else max([0.0, *(x["cover"] for x in spans)])
        return {"n_words": len(w), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *own})), "score": score, "spans": spans}


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double,template:string>>"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64()), ("template", pa.string())]))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row for each document: id, counts, labels, score, and the covered spans as word numbers. No shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        scanner = Scanner(templates, phrases)
        for b in (x for batch in batches for x in slices(batch)):
            got = [scanner.scan(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[n] for g in got], t) for n, t in zip(names, KINDS))], ["id", *names])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
