"""Licence scans: matching statistics against a generalised suffix automaton of licence texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import quoted

#: Phrases that name a licence wherever their words stand together.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Texts and notices of public licences. Their words count only, see words_of().
TEMPLATES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as
        being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
        our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>""",
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
        "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction
        and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works
        are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
        ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "gpl-2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either
        version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "lgpl-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
        either version 2.1 of the License, or (at your option) any later version.""",
    ),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""),
    ("epl-2", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"""),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl-2", "licensed under the GNU General Public License version 2"),
    ("bsd", "released under the BSD license"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
)
#: Upper case becomes lower case; ASCII that is no letter or digit becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text with A-Z in lower case."""
    return text.translate(FOLD).split()


class Automaton:
    """The generalised suffix automaton of several word sequences.

    A state stands for the factors that end at the same places. It knows its transitions, the
    length of its longest factor, its suffix link, and for each sequence that has the factors all
    places where they end, if its longest factor has at least `least` words.
    """

    def __init__(self, sequences: list[list[bytes]], least: int = 1):
        self.next: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.ends: list[dict[int, list[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, []).append(at + 1)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= least:
                up = self.ends[self.link[state]]
                for k, places in self.ends[state].items():
                    up[k] = sorted({*places, *up.get(k, ())})

    def _state(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The target of p by word, parted so that its longest factor is p's longest and the word."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word)
        return state


class Scanner:
    """Streams words through the automaton, and chains the long matches."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least: int = 4, gap: int = 8, coverage: float = 0.6):
        self.labels = [label for label, _ in (*phrases, *templates)]
        sequences = [words_of(text.encode()) for _, text in (*phrases, *templates)]
        self.sizes, self.n_phrases = [len(s) for s in sequences], len(phrases)
        self.least, self.gap, self.coverage = least, gap, coverage
        self.automaton = Automaton(sequences, least)
        # The phrases that are suffixes of a state's longest factor.
        self.closed: list[list[int]] = [[] for _ in self.automaton.next]
        for k in range(self.n_phrases):
            state = 0
            for word in sequences[k]:
                state = self.automaton.next[state][word]
            self.closed[state].append(k)
        for state in sorted(range(1, len(self.closed)), key=self.automaton.length.__getitem__):
            self.closed[state] = sorted({*self.closed[state], *self.closed[self.automaton.link[state]]})

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Phrase places (first word, phrase) and covered spans (template, first word, end, coverage)."""
        a = self.automaton
        nxt, link, length, closed, root = a.next, a.link, a.length, self.closed, a.next[0]
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # end in the text, length, state
        state = size = 0
        for i, word in enumerate(words):
            to = nxt[state].get(word)
            if to is None:
                if not state:
                    continue
                if size >= self.least:
                    matches.append((i, size, state))
                while state and (to := nxt[state].get(word)) is None:
                    state = link[state]
                    size = length[state]
                if to is None:
                    to = root.get(word)
                    size = 0
                    if to is None:
                        continue
            state = to
            size += 1
            if closed[state]:
                places += [(i + 1 - self.sizes[k], k) for k in closed[state] if size >= self.sizes[k]]
        if size >= self.least:
            matches.append((len(words), size, state))
        return places, self.chains(matches) if matches else []

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Matches of one template with at most `gap` words between them, as spans with their coverage.

        A match that stands at several places of the template counts at the next one in the template's order; if
        there is none, at the one that covers most new words, of equal ones at the first.
        """
        open_: dict[int, list[int]] = {}  # template: first word, end, covered template words as bits, end in the template
        done: list[tuple[int, int, int, float]] = []

        def close(k: int) -> None:
            first, end, bits, _ = open_.pop(k)
            done.append((k, first, end, bits.bit_count() / self.sizes[k]))

        for end, size, state in matches:
            for k, places in self.automaton.ends[state].items():
                if k in open_ and end - size - open_[k][1] > self.gap:
                    close(k)
                chain = open_.setdefault(k, [end - size, end, 0, 0])
                block = (1 << size) - 1
                at = next((p for p in places if p - size >= chain[3]), None)
                if at is None:
                    at = max(places, key=lambda p: ((block << (p - size) & ~chain[2]).bit_count(), -p))
                chain[1:] = end, chain[2] | block << (at - size), at
        for k in list(open_):
            close(k)
        return done

    def report(self, text: bytes) -> dict:
        """One row of scan_licenses()."""
        words = words_of(text)
        places, spans = self.scan(words)
        base = sorted({self.labels[k] for _, k in places})
        good = [s for s in spans if s[3] >= self.coverage]
        starts = [at for at, _ in places]
        spans_out = [{"label": self.labels[k], "first": first, "end": end, "coverage": c} for k, first, end, c in good]
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(self.labels[s[0]] for s in good)})),
            "score": max([s[3] for s in spans] + [1.0] * bool(places), default=0.0), "spans": spans_out,
        }


FIELDS = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))),
])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    base: all places where a phrase's words stand together; labels adds the labels of templates that
    a chain of matches of at least `least` words, with gaps of at most `gap`, covers to `coverage`
    or more. spans are those chains, in words. score is the best coverage of any template, 1 with a
    phrase. options: see Scanner.

    Null and empty texts have no words, empty labels, null places and score 0. Rows are scanned one
    by one: repeated rows repeat their result, and an empty table gives an empty result. Only the id and
    text columns are read, so other names cannot clash.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**options)
        for batch in batches:
            texts = batch.column(1)
            found = pa.RecordBatch.from_pylist([scanner.report(texts[k].as_py()) for k in range(batch.num_rows)], schema=FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], ["id", *FIELDS.names])

    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,end:bigint,coverage:double>>"
    return rows.mapInArrow(run, out)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).withColumnRenamed("id", "doc_id").drop("spans")


def license_phrases(spark, sf_dir: str) -> DataFrame:
    """The part of op9_license_scan that SQL can state: the places of the phrases."""
    return op9_license_scan(spark, sf_dir).drop("labels", "score")


def _places(phrase: str) -> str:
    """SQL: the places in the list w where the words of a phrase stand together."""
    words = phrase.split()
    return f"list_filter(range(greatest(0, len(w) - {len(words) - 1})), lambda i: w[i + 1:i + {len(words)}] = {words})"


#: Lists of places by label.
_LISTS = ", ".join(f"{_places(phrase)} AS p{k}" for k, (_, phrase) in enumerate(PHRASES))
SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (SELECT doc_id, w, {_LISTS} FROM words),
found AS (SELECT *, list_concat({", ".join(f"p{k}" for k in range(len(PHRASES)))}) AS every FROM placed)
SELECT doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(PHRASES))}], lambda x: x IS NOT NULL)), ',') AS base_labels
FROM found
"""
