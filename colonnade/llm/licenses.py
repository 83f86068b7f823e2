"""License scans: phrases, and an exact set-similarity join of lines and notices.

A line *contains* a notice if it holds at least THRESHOLD of the notice's
distinct words.  The words of the notices are ordered by their frequency in the
whole corpus, rarest first.  A line that contains a notice of n words holds
c = ceil(THRESHOLD * n) of them, hence one of the first n - c + 1 (prefix
filter); it has at least c distinct words (length filter); and of the line's
words in that order, those from its first match in the prefix on are at least c,
as words before the first match are none of the notice (positional filter).
Only lines that pass are compared, and none that contain a notice fails.

A wrapped notice stands in no single line.  Hence every run of words of about
the notice's length, across line breaks, is compared in the same way.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.text import Words, blocks, utf8, word_hash

THRESHOLD = 0.8
#: Words of a run for each word of the notice: room for comment marks and inserted words.
SPREAD = 1.25

#: Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Opening sentences of well-known license notices.
NOTICES = {
    "mit_notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache_notice": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "gpl_notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl_work": "This work is licensed under the GNU General Public License, version 3",
    "bsd_notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc_notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense_notice": "This is free and unencumbered software released into the public domain",
    "isc_notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}

#: Whole texts of short licenses and headers, found like the sentences above, over line breaks.
TEXTS = {
    "mit_text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc_text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd_text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "apache_header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "gpl_header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see"
    ),
}
NOTICES |= TEXTS


def _words_of(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]))


class Join:
    """Notices as word sets in frequency order, with the filters of their prefix."""

    def __init__(self, notices: dict[str, str], frequency: dict[int, int], threshold: float):
        self.notices = []
        self.by_word: dict[int, list[tuple[int, int]]] = {}
        for label, text in sorted(notices.items()):
            words = np.unique(_words_of(text).hash).tolist()
            words.sort(key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(words) - 1e-9)
            k = len(self.notices)
            self.notices.append((label, set(words), need))
            for word in words[: len(words) - need + 1]:
                self.by_word.setdefault(word, []).append(k)
        self.prefix = np.array(sorted(self.by_word), np.uint64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.prefix >> np.uint64(48)).astype(np.int64)] = True
        self.runs_of = [math.ceil(SPREAD * len(_words_of(text).hash)) for _, text in sorted(notices.items())]
        every = {w for _, notice, _ in self.notices for w in notice}
        #: Place of each word of any notice in the order of frequency.
        self.place = {w: p for p, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
        self.words = np.array(sorted({w for _, notice, _ in self.notices for w in notice}), np.uint64)
        self.member = np.array([[w in notice for w in self.words.tolist()] for _, notice, _ in self.notices], bool)
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def runs(self, words: Words):
        """(text, label, containment) of texts with a run of words that contains a notice: the run with the most."""
        some = np.flatnonzero(self.known[(words.hash >> np.uint64(48)).astype(np.int64)])
        if not len(some) or not len(self.words):
            return
        word = np.minimum(np.searchsorted(self.words, words.hash[some]), len(self.words) - 1)
        same = self.words[word] == words.hash[some]
        some, word = some[same], word[same]
        for (label, notice, need), size, member in zip(self.notices, self.runs_of, self.member, strict=True):
            own = member[word]
            at, held = some[own], word[own]
            text = words.text[at]
            # Runs that begin at a word of the notice and hold enough of its words, repeated ones included.
            end = np.minimum(np.searchsorted(at, at + size), np.searchsorted(text, text, "right"))
            first = np.flatnonzero(end - np.arange(len(at)) >= max(need, 1))
            if not len(first):
                continue
            before = np.full(len(at), -1)
            order = np.argsort(held, kind="stable")
            again = held[order][1:] == held[order][:-1]
            before[order[1:][again]] = order[:-1][again]
            both = np.zeros(len(first), np.int64)
            for step in range(size):
                k = np.minimum(first + step, len(at) - 1)
                both += (first + step < end[first]) & (before[k] < first)
            enough = both >= need
            most: dict[int, int] = {}
            for t, n in zip(text[first[enough]].tolist(), both[enough].tolist(), strict=True):
                most[t] = max(n, most.get(t, 0))
            for t, n in most.items():
                yield t, label, n / len(notice)

    def lines(self, words: Words, line: np.ndarray):
        """(text, label, containment) of lines that contain a notice; ``line`` numbers the words' lines."""
        some = np.flatnonzero(self.seen[(words.hash >> np.uint64(48)).astype(np.int64)])
        if not len(some) or not len(self.prefix):
            return
        place = np.minimum(np.searchsorted(self.prefix, words.hash[some]), len(self.prefix) - 1)
        some = some[self.prefix[place] == words.hash[some]]
        for number in np.unique(line[some]).tolist():
            lo, hi = np.searchsorted(line, [number, number + 1])
            held = set(words.hash[lo:hi].tolist())
            for k in self.candidates(held):
                label, notice, need = self.notices[k]
                both = len(held & notice)
                if both >= need:
                    yield int(words.text[lo]), label, both / len(notice)

    def candidates(self, held: set[int]) -> list[int]:
        """Notices that pass the prefix, length and positional filters for a line of these words."""
        first: dict[int, int] = {}
        for word in held & self.by_word.keys():
            for k in self.by_word[word]:
                first[k] = min(self.place[word], first.get(k, len(self.place)))
        places = sorted(self.place[w] for w in held & self.place.keys())
        out = []
        for k, p in first.items():
            need = self.notices[k][2]
            if len(held) >= need and len(places) - bisect_left(places, p) >= need:
                out.append(k)
        return out


def word_frequency(docs: DataFrame, words: list[int]) -> dict[int, int]:
    """Occurrences of the given word hashes in all texts."""
    goal = np.array(sorted(set(words)), np.uint64)

    def count(batches):
        total = np.zeros(len(goal), np.int64)
        seen = np.zeros(1 << 16, bool)
        seen[(goal >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                h = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).hash
                h = h[seen[(h >> np.uint64(48)).astype(np.int64)]]
                place = np.minimum(np.searchsorted(goal, h), len(goal) - 1)
                total += np.bincount(place[goal[place] == h], minlength=len(goal))
        yield pa.RecordBatch.from_arrays([pa.array(goal.view(np.int64)), pa.array(total)], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n"))
    return {int(np.int64(w).view(np.uint64)): n for w, n in counted.collect()}


_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long,"
    " base_labels string, labels string, score double"
)


def scan_licenses(
    docs: DataFrame, notices: dict[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: words, places of phrases, labels, and a score.

    score is 1 where a phrase stands, else the highest containment of a notice
    found, else 0.  Null texts count as empty (no words, no labels, score 0);
    repeated rows keep a row each; an empty table gives an empty result.  Other
    columns are ignored.
    """
    notices = NOTICES if notices is None else notices
    vocabulary = [w for text in notices.values() for w in _words_of(text).hash.tolist()]
    frequency = word_frequency(docs, vocabulary) if vocabulary else {}
    phrases = [([word_hash(w) for w in p.split()], label) for p, label in PHRASES.items()]

    def run(batches):
        join = Join(notices, frequency, threshold)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = batch.num_rows
            counts = np.zeros(n, np.int64)
            base: dict[int, list] = {}
            more: dict[int, dict] = {}
            for i, j in blocks(offsets):
                part = data[offsets[i] : offsets[j]]
                words = Words(part, offsets[i : j + 1] - offsets[i])
                counts[i:j] = words.counts
                h = words.hash
                for phrase, label in phrases:
                    k = len(phrase)
                    if len(h) < k:
                        continue
                    same = h[: len(h) - k + 1] == phrase[0]
                    for step in range(1, k):
                        same &= h[step : len(h) - k + 1 + step] == phrase[step]
                    at = np.flatnonzero(same)
                    at = at[words.text[at] == words.text[at + k - 1]]
                    for w in at.tolist():
                        t = int(words.text[w])
                        base.setdefault(t + i, []).append((w - int(words.first[t]), label))
                line = np.searchsorted(np.flatnonzero(part == 10), words.start) + words.text
                for t, label, share in chain(join.lines(words, line), join.runs(words)):
                    own = more.setdefault(t + i, {})
                    own[label] = max(share, own.get(label, 0.0))
            rows = []
            for t in range(n):
                places, found = base.get(t, []), more.get(t, {})
                at = [p for p, _ in places]
                own = {label for _, label in places}
                rows.append((
                    len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
                    ",".join(sorted(own | found.keys())), 1.0 if at else max(found.values(), default=0.0),
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            arrays = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *arrays], list(_COLUMNS))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
