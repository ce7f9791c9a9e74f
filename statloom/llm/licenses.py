"""License scans: matching statistics against a generalised suffix automaton of licence words, chained into spans.

The automaton holds every run of words of every template. Streaming a document's words through it gives, at each word,
the longest run ending there that some template contains. Runs of MIN_MATCH words or more that can't be extended are
anchors; anchors of one template in the same order in both texts, at most MAX_GAP words apart, are chained, and a chain
that covers enough of its template is a span. Words are found and numbered by numpy over whole Arrow batches; only runs
of words that templates use go through the automaton. No shuffle: the work follows the scan, whatever a source holds.

Defined results: a null text is an empty one: no words, no places, empty labels, score 0; repeated rows are scanned
each for itself; an empty table gives an empty result; columns of the input that clash with an added name are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name, held, text_blocks, without

MIN_MATCH = 3  # words of an anchor
MAX_GAP = 6  # words between anchors of a chain, in the document and in the template
COVERED = 0.75  # of a template's words, for a span

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Licence passages, by label.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    # whole licences
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
        program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
)

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(text: str) -> list[str]:
    """The words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    return [w for w in bytes(np.where(_WORD[raw], raw, 32).astype(np.uint8)).decode().split(" ") if w]


class SuffixAutomaton:
    """All runs of all sequences; ends[state] lists where its runs end, as (sequence, place)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for at, w in enumerate(seq):
                last = self._add(last, w)
                self.ends[last].append((k, at))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] += self.ends[v]
        self.ends[0] = []

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state after w from p whose longest run is p's longest and w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an earlier sequence begins alike
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w)
        return new

    def anchors(self, stream: list[int], least: int) -> list[tuple[int, int, int]]:
        """(last word's place, length, state) of runs that no word before or after extends."""
        state, n, found = 0, 0, []
        for at, w in enumerate(stream):
            before = n, state
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            if before[0] >= least and n <= before[0]:
                found.append((at - 1, *before))
        if n >= least:
            found.append((len(stream) - 1, n, state))
        return found


def chains(anchors: list[tuple[int, int, int]], size: int, gap: int) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of the best disjoint chains. anchors: (document place, template place, length)."""
    anchors = sorted(anchors)
    best: list[tuple[int, int]] = []  # covered, the anchor before
    low = 0
    for i, (d, t, n) in enumerate(anchors):
        own = (n, -1)
        while anchors[low][0] < d - 2 * (size + gap):
            low += 1
        for j in range(low, i):
            e, u, m = anchors[j]
            lap = max(0, e + m - d, u + m - t)
            if e < d and u < t and lap < n and d - e - m <= gap and t - u - m <= gap and best[j][0] + n - lap > own[0]:
                own = (best[j][0] + n - lap, j)
        best.append(own)
    taken, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: (-best[i][0], i)):
        path, k = [], i
        while k >= 0 and not taken[k]:
            path.append(k)
            k = best[k][1]
        if k >= 0 or not path:
            continue
        for k in path:
            taken[k] = True
        out.append((anchors[path[-1]][0], anchors[i][0] + anchors[i][2] - 1, best[i][0]))
    return out


class Scanner:
    def __init__(self) -> None:
        self.templates = [words_of(t) for _, t in TEMPLATES]
        names = sorted({w for t in self.templates for w in t} | {w for p, _ in BASE for w in p.split()})
        self.number = {w.encode(): i for i, w in enumerate(names)}
        self.automaton = SuffixAutomaton([[self.number[w.encode()] for w in t] for t in self.templates])
        self.base = [([self.number[w.encode()] for w in p.split()], label) for p, label in BASE]
        keys = np.array([self._key(w) for w in self.number], np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self._mixed(keys)] = True
        self.lengths = np.zeros(64, bool)
        self.lengths[[min(63, len(w)) for w in self.number]] = True

    @staticmethod
    def _key(word: bytes) -> int:
        return int.from_bytes(word[:8].ljust(8, b"\0"), "little")

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for words of no template."""
        out = np.full(len(starts), -1, np.int32)
        at = np.flatnonzero(self.lengths[np.minimum(sizes, 63)])
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts[at]]
        keys = np.ascontiguousarray(eight).view("<u8").ravel()
        short = np.minimum(sizes[at], 8).astype(np.uint64)
        keys &= np.where(short == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        maybe = self.sieve[self._mixed(keys)]
        at, keys = at[maybe], keys[maybe]
        first = np.searchsorted(self.keys, keys)
        ok = self.keys[np.minimum(first, len(self.keys) - 1)] == keys
        at, first = at[ok], first[ok]
        brief = sizes[at] < 8  # a key of fewer than eight bytes is the word
        out[at[brief]] = self.order[first[brief]]
        for i in at[~brief].tolist():
            out[i] = self.number.get(raw[starts[i] : starts[i] + sizes[i]].tobytes(), -1)
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
        """One result for each text; data holds their bytes, offsets their borders."""
        raw = _LOWER[data]
        inside = _WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(raw) else inside
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(raw) else inside
        sizes = np.flatnonzero(inside & ~after) + 1 - starts
        numbers = self._numbers(raw, starts, sizes)
        border = np.searchsorted(starts, offsets)  # of each text's words
        doc_of = lambda place: np.searchsorted(border, place, "right") - 1
        hits: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for phrase, label in self.base:
            n = len(phrase)
            at = np.flatnonzero(numbers[: len(numbers) - n + 1] == phrase[0])
            for k in range(1, n):
                at = at[numbers[at + k] == phrase[k]]
            docs = doc_of(at)
            whole = docs == doc_of(at + n - 1)
            for d, i in zip(docs[whole].tolist(), at[whole].tolist(), strict=True):
                hits[d].append((i - int(border[d]), label))
        known = numbers >= 0
        first = known.copy()
        first[1:] &= ~known[:-1]
        first[border[:-1][border[:-1] < len(known)]] = True
        first &= known
        run_starts = np.flatnonzero(first)
        gaps = np.flatnonzero(~known | first)  # where a run can end
        run_ends = np.append(gaps, len(known))[np.searchsorted(gaps, run_starts, "right")]
        long = run_ends - run_starts >= MIN_MATCH
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for a, b in zip(run_starts[long].tolist(), run_ends[long].tolist(), strict=True):
            got = self.automaton.anchors(numbers[a:b].tolist(), MIN_MATCH)
            if got:
                d = int(doc_of(a))
                for last, n, state in got:
                    for k, end in self.automaton.ends[state]:
                        found[d][k].append((a + last - n + 1 - int(border[d]), end - n + 1, n))
        out = []
        for d in range(len(offsets) - 1):
            places, spans, score = hits.get(d, []), [], 0.0
            for k, anchors in sorted(found.get(d, {}).items()):
                size = len(self.templates[k])
                for a, b, covered in chains(anchors, size, MAX_GAP):
                    part = min(1.0, covered / size)
                    score = max(score, part)
                    if part >= COVERED:
                        spans.append({"label": TEMPLATES[k][0], "template": k, "first_word": a, "last_word": b, "coverage": part})
            own = {label for _, label in places}
            at = [i for i, _ in places]
            out.append({
                "n_words": int(border[d + 1] - border[d]),
                "n_base": len(places),
                "first_word": min(at, default=None),
                "last_word": max(at, default=None),
                "base_labels": ",".join(sorted(own)),
                "labels": ",".join(sorted(own | {s["label"] for s in spans})),
                "score": score,
                "spans": sorted(spans, key=lambda s: (s["first_word"], s["template"])),
            })
        return out



RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,spans:array<struct<label:string,template:int,first_word:long,last_word:long,coverage:double>>>"
_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
_RESULT = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and spans."""

    @arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held("licenses", Scanner)
        for texts in batches:
            got: list[dict] = []
            for data, offsets in text_blocks(texts):
                got += own.scan(data, offsets)
            yield pa.array(got, _RESULT)

    names = [f.name for f in _RESULT]
    kept = without(docs, *names)
    own = free_name(kept, "scan")
    return kept.withColumn(own, scan(F.coalesce(F.col(text), F.lit("")))).select(*(F.col(f"`{c}`") for c in kept.columns), f"{own}.*")
