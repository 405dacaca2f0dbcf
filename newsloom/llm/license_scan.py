"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of all templates. A file streams through it once, which gives
its matching statistics: at each token, the longest run ending there that some template contains.
Long matches are then chained, in order, into the span of a template that they cover.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and their labels (fixed values).
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Public licence texts, the parts by which a licence is known (fixed values).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("bsd", "This work is licensed under the BSD 3-Clause License."),
    ("mpl-2", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
]
#: A match counts from this many tokens on; a chain may skip this many tokens of either text between two matches.
MIN_MATCH, MAX_GAP = 4, 12
#: Share of a template's tokens that a chain must cover to give its label.
MIN_COVER = 0.8

_UPPER = bytes(range(65, 91))
_KEEP = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_TABLE = bytes(b + 32 if b in _UPPER else b if b in _KEEP else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Of several token sequences; each state keeps one place (template, end) of its strings."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.place = [-1], [0], [(-1, -1)]
        for t, tokens in enumerate(templates):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token, (t, i))

    def _new(self, length: int, link: int, moves: dict, place: tuple[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of q for the strings that are one longer than p's."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), self.place[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int, place: tuple[int, int]) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        state, p = self._new(self.length[last] + 1, 0, {}, place), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return state

    def matches(self, tokens: list[int], least: int):
        """(end, length, state) of matches that can't be lengthened to the right."""
        state = n = 0
        for i, token in enumerate(tokens):
            if token not in self.next[state]:
                if n >= least:
                    yield i, n, state
                while state and token not in self.next[state]:
                    state = self.link[state]
                n = self.length[state]
            state = self.next[state].get(token, 0)
            n = n + 1 if state else 0
        if n >= least:
            yield len(tokens), n, state


class Scanner:
    """Built in each task from the fixed templates."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.base = [(words(p), label) for p, label in phrases]
        self.starts: dict[bytes, list] = {}
        for p, label in self.base:
            self.starts.setdefault(p[0], []).append((p, label))
        texts = [words(t) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.ids: dict[bytes, int] = {}
        for t in texts:
            for w in t:
                self.ids.setdefault(w, len(self.ids))
        self.tokens = [[self.ids[w] for w in t] for t in texts]
        self.automaton = SuffixAutomaton(self.tokens)
        # all places of a match: which templates hold its first MIN_MATCH tokens, and where
        self.places: dict[tuple, list] = {}
        for t, tokens in enumerate(self.tokens):
            for i in range(len(tokens) - MIN_MATCH + 1):
                self.places.setdefault(tuple(tokens[i : i + MIN_MATCH]), []).append((t, i))

    def base_places(self, ws: list[bytes]) -> list[tuple[int, str]]:
        out = []
        for first, rules in self.starts.items():
            at = -1
            while True:
                try:
                    at = ws.index(first, at + 1)
                except ValueError:
                    break
                out += [(at, label) for p, label in rules if ws[at : at + len(p)] == p]
        return out

    def chains(self, ws: list[bytes]) -> list[dict]:
        """Covered spans: label, first and last word, tokens covered, share of the template."""
        get, matches, run, begin = self.ids.get, [], [], 0
        for i, w in enumerate(ws):
            k = get(w)
            if k is not None:
                if not run:
                    begin = i
                run.append(k)
            elif run:
                if len(run) >= MIN_MATCH:
                    matches += [(begin + end - n, n) for end, n, _ in self.automaton.matches(run, MIN_MATCH)]
                run = []
        if len(run) >= MIN_MATCH:
            matches += [(begin + end - n, n) for end, n, _ in self.automaton.matches(run, MIN_MATCH)]
        open_: dict[int, list[dict]] = {}
        done = []
        for start, n in matches:
            ids = [self.ids[w] for w in ws[start : start + n]]
            for t, at in self.places.get(tuple(ids[:MIN_MATCH]), ()):
                if self.tokens[t][at : at + n] != ids:
                    continue
                live = []
                best = None
                for c in open_.get(t, ()):
                    if start - c["last"] - 1 > MAX_GAP:
                        done.append(c)
                    else:
                        live.append(c)
                        if c["to"] - n < at and 0 <= at - c["to"] + MAX_GAP and at - c["to"] <= MAX_GAP and start > c["first"] and (best is None or c["covered"] > best["covered"]):
                            best = c
                if best is not None:
                    best |= {"last": start + n - 1, "covered": best["covered"] + max(0, min(at + n - best["to"], start + n - 1 - best["last"])), "to": max(best["to"], at + n)}
                else:
                    live.append({"t": t, "first": start, "last": start + n - 1, "covered": n, "to": at + n})
                open_[t] = live
        done += [c for live in open_.values() for c in live]
        return [{"label": self.labels[c["t"]], "first": c["first"], "last": c["last"], "tokens": c["covered"], "cover": min(1.0, c["covered"] / len(self.tokens[c["t"]]))} for c in done]

    def scan(self, text: str | None) -> dict:
        ws = words(text)
        base = self.base_places(ws)
        spans = [c for c in self.chains(ws) if c["cover"] >= MIN_COVER]
        base_labels = {label for _, label in base}
        score = 1.0 if base else max((c["cover"] for c in spans), default=0.0)
        return {
            "n_words": len(ws), "n_base": len(base), "first_word": min((a for a, _ in base), default=None), "last_word": max((a for a, _ in base), default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {c["label"] for c in spans})), "score": score, "spans": spans,
        }


TYPES = {
    "n_words": ("long", pa.int64()), "n_base": ("long", pa.int64()), "first_word": ("long", pa.int64()), "last_word": ("long", pa.int64()),
    "base_labels": ("string", pa.string()), "labels": ("string", pa.string()), "score": ("double", pa.float64()),
    "spans": ("array<struct<label:string,first:long,last:long,tokens:long,cover:double>>", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("tokens", pa.int64()), ("cover", pa.float64())]))),
}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and, over the whole text: n_words, the base phrases' places (n_base, first_word and
    last_word, null without any), base_labels, labels with those of covered templates too, score (1
    if a base phrase stands, else the largest covered share) and the covered spans.

    One pass without a shuffle. A null text is an empty one: no words, no labels (empty strings), score 0.
    Rows are answered one by one, repeated ones too; other columns of ``docs`` aren't read.
    """

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            got = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[c] for g in got], t) for c, (_, t) in TYPES.items()]], names=["doc_id", *TYPES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, (t, _) in TYPES.items()))
