"""License scans: templates with optional and replaceable regions as token automata.

A template is a line of words. ``[[ ... ]]`` encloses words that may be left out
and ``<<name:least,most>>`` stands for so many words of any kind. It is compiled
into an automaton over words whose steps are mandatory words, optional words and
free words; a text is accepted where all mandatory wording matches exactly and
in order. Every place is tried where a run can begin: at the first word of the
mandatory wording or of an optional region before it, with the word behind it.

There are templates for whole licenses, whose mandatory wording is all of the license,
and for notices: sentences that put a work under a license.

Defined results: a null or empty text has no words, no places and no labels, and
scores 0. Score is the largest part of any template's mandatory words that was
met in one run of its automaton; it is 1 where a label was given. Of spans of one label
with one end the longest is given. Repeated rows are each scanned; very long texts
are scanned whole, with a run of bounded length for each place. The carried columns
are the caller's choice; others are not looked at, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from geoweave.llm import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrases whose places are counted, with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices that put a work under a license.
NOTICES = (
    ("mit", "spdx license identifier mit"),
    ("gpl-3", "licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<scheme:0,1>> mozilla org mpl 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<scheme:0,1>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("cc-by-nc", "licensed under [[a]] [[the]] creative commons attribution noncommercial <<version:0,3>> license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] creative commons attribution sharealike <<version:0,3>> license"),
)

# Whole wording of public licenses.
BSD_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_NAMES = "[[3]] neither the name of <<holder:1,12>> nor the names of [[its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_DISCLAIMER = "this software is provided by <<holder:1,12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<holder:1,12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<holders:1,12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<author:1,6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<author:1,6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
COPYRIGHT = "[[copyright <<holder:1,30>>]] [[all rights reserved]]"
LICENSES = (
    ("mit", f"[[[[the]] mit license [[mit]]]] {COPYRIGHT} {MIT}"),
    ("isc", f"[[[[the]] isc license]] {COPYRIGHT} {ISC}"),
    ("bsd-2", f"[[bsd 2 clause license]] {COPYRIGHT} {BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("bsd-3", f"[[bsd 3 clause license]] {COPYRIGHT} {BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"),
)
TEMPLATES = NOTICES + LICENSES

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, last long>>"


class Automaton:
    """Steps are words or None (any word); ``jumps`` lead over what may be left out."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.steps: list[bytes | None] = []
        self.weight: list[int] = []
        jumps: list[tuple[int, int]] = []
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|<<[^>]*>>|[^\s\[\]<>]+", template):
            if part == "[[":
                opened.append(len(self.steps))
            elif part == "]]":
                jumps.append((opened.pop(), len(self.steps)))
            elif part.startswith("<<"):
                least, most = (int(x) for x in part[2:-2].split(":")[1].split(","))
                first = len(self.steps)
                self.steps += [None] * most
                self.weight += [0] * most
                jumps += [(first + k, first + most) for k in range(least, most)]
            else:
                self.steps.append(part.encode().lower())
                self.weight.append(0 if opened else 1)
        self.size = len(self.steps)
        closure = [{i} for i in range(self.size + 1)]
        for i in range(self.size, -1, -1):
            for a, b in jumps:
                if a == i:
                    closure[i] |= closure[b]
        self.closure = [sum(1 << x for x in c) for c in closure]
        self.on_any = sum(1 << i for i, s in enumerate(self.steps) if s is None)
        self.on_word: dict[bytes, int] = {}
        for i, s in enumerate(self.steps):
            if s is not None:
                self.on_word[s] = self.on_word.get(s, 0) | 1 << i
        self.met = [0]
        for x in self.weight:
            self.met.append(self.met[-1] + x)
        first = [i for i in range(self.size + 1) if self.closure[0] >> i & 1]
        if opened or not self.met[-1] or self.size in first or any(self.steps[i] is None for i in first):
            raise ValueError(f"a template has mandatory words, and none that are free before them: {template!r}")
        #: Words that a run begins with, and the word behind them; None: any, or none at all.
        self.heads: set[tuple[bytes, bytes | None]] = set()
        for i in first:
            behind = [self.steps[j] if j < self.size else None for j in range(self.size + 1) if self.closure[i + 1] >> j & 1]
            self.heads |= {(self.steps[i], None)} if None in behind else {(self.steps[i], word) for word in behind}

    def run(self, words: Iterator[bytes]) -> tuple[int, float]:
        """How many words the longest accepted run has (0: none), and the largest part of the mandatory words met."""
        active, accepted, best = self.closure[0], 0, 0
        for n, word in enumerate(words, 1):
            hit = active & (self.on_word.get(word, 0) | self.on_any)
            if not hit:
                break
            active = 0
            while hit:
                low = hit & -hit
                k = low.bit_length()
                active |= self.closure[k]
                best = max(best, self.met[k])
                hit ^= low
            if active >> self.size & 1:
                accepted = n
        return accepted, 1.0 if accepted else best / self.met[-1]


def scan_slice(data: np.ndarray, offsets: np.ndarray, phrases, automata: list[Automaton], heads) -> list[tuple]:
    w = tx.Words(data, offsets, tx.ALNUM, True)
    raw = data.tobytes()

    def word(i: int) -> bytes:
        return raw[w.start[i] : w.end[i]].lower()

    places: dict[int, list[tuple[int, str]]] = {}
    for label, words, hashes in phrases:
        n = len(words)
        if len(w.hash) >= n:
            hit = np.ones(len(w.hash) - n + 1, bool)
            for k in range(n):
                hit &= w.hash[k : len(w.hash) - n + 1 + k] == hashes[k]
            for i in np.flatnonzero(hit):
                if w.doc[i] == w.doc[i + n - 1] and all(word(i + k) == words[k] for k in range(n)):
                    places.setdefault(int(w.doc[i]), []).append((int(i), label))
    spans: dict[int, dict[tuple[str, int], int]] = {}  # of each text: by label and last word, the first word
    part: dict[int, float] = {}
    starts: dict[int, set[int]] = {}
    for (one, two), group in heads.items():
        if two is None:
            at = np.flatnonzero(w.hash == one)
        else:
            at = np.flatnonzero((w.hash[:-1] == one) & (w.hash[1:] == two) & (w.doc[:-1] == w.doc[1:]))
        for k in group if len(at) else ():
            starts.setdefault(k, set()).update(at.tolist())
    for k, at in starts.items():
        a = automata[k]
        for i in sorted(at):
            d = int(w.doc[i])
            first, stop = int(w.first[d]), int(w.first[d + 1])
            n, share = a.run(word(q) for q in range(i, stop))
            part[d] = max(part.get(d, 0.0), share)
            if n:
                spans.setdefault(d, {}).setdefault((a.label, i - first + n - 1), i - first)
    rows = []
    for d in range(w.rows):
        at, found = places.get(d, []), sorted(((label, b, c) for (label, c), b in spans.get(d, {}).items()), key=lambda x: (x[1], x[2], x[0]))
        base = {label for _, label in at}
        labels = base | {x[0] for x in found}
        first = int(w.first[d])
        rows.append((int(w.counts[d]), len(at), min(at)[0] - first if at else None, max(at)[0] - first if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if labels else part.get(d, 0.0), [{"label": a, "first": b, "last": c} for a, b, c in found]))
    return rows


def license_scan(documents: DataFrame, carry: list[str] | None = None, base_phrases=BASE_PHRASES, templates=TEMPLATES) -> DataFrame:
    """The ``carry`` columns of every row with its counts, labels, score and accepted spans (in words)."""
    carry = ["doc_id"] if carry is None else carry
    types = dict(documents.dtypes)
    names = [*carry, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(label, [x.encode() for x in p.split()], [np.uint64(tx.word_hash(x)) for x in p.split()]) for p, label in base_phrases]
        automata = [Automaton(label, t) for label, t in templates]
        heads: dict = {}
        for k, a in enumerate(automata):
            for pair in a.heads:
                heads.setdefault(tuple(None if x is None else np.uint64(tx.word_hash(x.decode())) for x in pair), []).append(k)
        for b in batches:
            rows = [r for _, _, data, offsets in tx.slices(b.column(0)) for r in scan_slice(data, offsets, phrases, automata, heads)]
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x, type=k) for x, k in zip(zip(*rows), kinds))], names)

    return documents.select("text", *carry).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in carry), SCHEMA]))
