"""Licence scan: a generalised suffix automaton over licence tokens gives matching statistics, which are chained into covered template spans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_of, map_arrow, without_clash
from .words import ALNUM, LOWER, span_hashes, text_slices

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Openings, clauses, disclaimers and one-line notices of public licences, as (label, text).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "Copyright. All rights reserved"),
    ("reserved", "All rights reserved"),
]


def tokens(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return bytes(np.where(ALNUM[data], data, 32).astype(np.uint8)).split()


class Automaton:
    """Suffix automaton of several token sequences. Each state knows, per template, where its longest string first ends there."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.ends: list[dict[int, int]] = [{} for _ in self.next]
        for t, seq in enumerate(sequences):
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                u = v
                while u > 0 and t not in self.ends[u]:
                    self.ends[u][t] = i + 1
                    u = self.link[u]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """Longest suffix of what was read, with c, that some template holds."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        return (self.next[state][c], length + 1) if c in self.next[state] else (0, 0)

    def has_suffix(self, state: int, length: int, target: int, size: int) -> bool:
        """Whether the last size tokens are the string of state target."""
        if length < size:
            return False
        while self.link[state] >= 0 and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state == target


@dataclass
class Scanner:
    """min_match: words of a match that counts; max_gap: unmatched words inside a span; min_cover: share of a template that labels.

    A template of fewer than min_match words counts wherever it stands whole, within longer matches too.
    """

    phrases: list[tuple[str, str]]
    templates: list[tuple[str, str]]
    min_match: int = 4
    max_gap: int = 6
    min_cover: float = 0.6

    def __post_init__(self):
        seqs = [tokens(t) for t, _ in self.phrases] + [tokens(t) for _, t in self.templates]
        self.labels = [label for _, label in self.phrases] + [label for label, _ in self.templates]
        self.words = sorted({w for s in seqs for w in s})
        ids = {w: i + 1 for i, w in enumerate(self.words)}
        self.seqs = [[ids[w] for w in s] for s in seqs]
        self.automaton = Automaton(self.seqs)
        self.short = [t for t in range(len(self.phrases), len(self.seqs)) if 0 < len(self.seqs[t]) < self.min_match]
        self.base, self.whole = [], []
        for found, ts in ((self.base, range(len(self.phrases))), (self.whole, self.short)):
            for t in ts:
                v = 0
                for c in self.seqs[t]:
                    v = self.automaton.next[v][c]
                found.append((t, v, len(self.seqs[t])))
        joined = np.frombuffer(b"".join(self.words), np.uint8)
        stops = np.cumsum([len(w) for w in self.words])
        h = span_hashes(joined, np.concatenate(([0], stops[:-1])), stops)
        self.order = np.argsort(h)
        self.known = h[self.order]
        n = len(self.words) + 1
        self.pair = np.zeros((n, n), bool)  # bigrams that some template holds
        self.opens = np.zeros((n, n), bool)  # bigrams that open a phrase or a short template
        for k, s in enumerate(self.seqs):
            for a, b in zip(s, s[1:], strict=False):
                self.pair[a, b] = True
            if (k < len(self.phrases) or k in self.short) and len(s) > 1:
                self.opens[s[0], s[1]] = True
        self.single = {self.seqs[k][0] for k in (*range(len(self.phrases)), *self.short) if len(self.seqs[k]) == 1}

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.order[at] + 1, 0)

    def runs(self, ids: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges outside which no match reaches min_match words and no phrase or short template stands."""
        if len(ids) < 1:
            return []
        ok = self.pair[ids[:-1], ids[1:]] & (row[:-1] == row[1:])
        edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        opening = np.concatenate(([0], np.cumsum(ok & self.opens[ids[:-1], ids[1:]])))
        want = (hi - lo >= self.min_match) | (opening[hi - 1] > opening[lo])
        out = [(int(a), int(b)) for a, b in zip(lo[want], hi[want], strict=True)]
        if self.single:
            inside = np.zeros(len(ids) + 1, np.int8)
            for a, b in out:
                inside[a:b] = 1
            out += [(int(i), int(i) + 1) for i in np.flatnonzero(np.isin(ids, list(self.single))) if not inside[i]]
        return sorted(out)

    def scan(self, ids: list[int], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrase places (start, phrase) and maximal matches (template, start, place in template, words) of one run.

        Short templates give their whole occurrences instead.
        """
        auto, state, length = self.automaton, 0, 0
        places, matches = [], []
        for i, c in enumerate([*ids, -1]):
            before = (state, length)
            state, length = auto.step(state, length, c)
            if length != before[1] + 1 and before[1] >= self.min_match:
                matches += [(t, at + i - before[1], e - before[1], before[1]) for t, e in auto.ends[before[0]].items() if t >= len(self.phrases) and t not in self.short]
            for k, target, size in self.base:
                if auto.has_suffix(state, length, target, size):
                    places.append((at + i + 1 - size, k))
            matches += [(t, at + i + 1 - size, 0, size) for t, target, size in self.whole if auto.has_suffix(state, length, target, size)]
        return places, matches

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains matches of one template that come in its order with small gaps; (label, start, end, share covered)."""
        out = []
        by: dict[int, list] = {}
        for m in sorted(matches):
            by.setdefault(m[0], []).append(m)
        for t, found in by.items():
            size, chain = len(self.seqs[t]), None
            for _, start, place, n in found:
                if chain and start - chain[1] <= self.max_gap and place >= chain[2]:
                    chain[3] += n - max(0, chain[1] - start)
                    chain[1], chain[2] = start + n, place + n
                else:
                    if chain:
                        out.append((self.labels[t], chain[0], chain[1], min(1.0, chain[3] / size)))
                    chain = [start, start + n, place + n, n]
            out.append((self.labels[t], chain[0], chain[1], min(1.0, chain[3] / size)))
        return sorted(out)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"


def licence_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, templates=None, **limits) -> DataFrame:
    """One row per input row: its id, phrase places, labels, score and the template spans in words.

    Streams the rows: no shuffle, and memory for about a megabyte of text beside the longest single text. A null or
    empty text has no words: zeros, null places, empty labels, score 0. Repeated rows each give their row; an empty
    table gives an empty result; other columns are ignored, whatever their names. The score is the largest share of a
    template that a span covers, and 1 where a phrase stands.
    """
    scanner = Scanner(phrases or BASE_PHRASES, TEMPLATES if templates is None else templates, **limits)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        fields = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
        for batch in batches:
            keys, texts = columns_of(batch, ["id", "text"])
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for s in text_slices(texts):
                data = LOWER[s.data]
                s.split(ALNUM)
                ids = scanner.ids(span_hashes(data, s.starts, s.ends))
                row = s.row_of_word()
                per: dict[int, tuple[list, list]] = {}
                for a, b in scanner.runs(ids, row):
                    r = int(row[a])
                    places, matches = scanner.scan(ids[a:b].tolist(), a - int(s.bounds[r]))
                    mine = per.setdefault(r, ([], []))
                    mine[0].extend(places)
                    mine[1].extend(matches)
                for r in range(s.rows):
                    places, matches = per.get(r, ((), ()))
                    spans = scanner.spans(matches) if matches else []
                    base = {scanner.labels[k] for _, k in places}
                    out["n_words"].append(int(s.bounds[r + 1] - s.bounds[r]))
                    out["n_base"].append(len(places))
                    out["first_word"].append(min((p for p, _ in places), default=None))
                    out["last_word"].append(max((p for p, _ in places), default=None))
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base | {x[0] for x in spans if x[3] >= scanner.min_cover})))
                    out["score"].append(max([1.0 if places else 0.0, *(x[3] for x in spans)]))
                    out["spans"].append([dict(zip(("label", "start", "end", "covered"), x, strict=True)) for x in spans])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(fields)]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["id", *out])

    src = without_clash(df, id_col, text_col).toDF("id", "text")
    return map_arrow(src, run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
