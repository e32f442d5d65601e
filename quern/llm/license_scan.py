"""License notices in texts: fixed phrases, and an exact containment join of text blocks with notice templates.

A block (a line, or a run of words within a longer line or over several lines) is at most as long as the template's words by the
threshold; block and template are sets of words. The join finds every block that holds at least `threshold` of a template's
words, and all of those that name a licence. Template words are ordered by how many
documents hold them, rarest first; a block can only reach the threshold if it holds a word of the template's prefix in that
order (prefix filter), has enough distinct words (length filter), and if behind the first shared word both the template and
the block have enough words left (positional filter). The templates and their prefix index are of fixed size and broadcast;
the documents are never shuffled. Where notices differ by a word or two, the template that explains more of the block's
words wins.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WORD_BYTES, map_batches, utf8

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices in their usual wording, one or more a label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT license."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "Licensed under the GNU General Public License, version 2."),
    ("gpl", "Licensed under the GNU General Public License, version 3."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This content is licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted without prior written permission"),
)

# Words that name a licence: what of them stands in a template must stand in a block.
NAMES = "mit apache bsd gnu affero lesser mozilla cc nc sa nd creative commons noncommercial sharealike noderivatives eclipse boost unencumbered reserved".split()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z: runs of a-z, 0-9 and everything beyond ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


def template_frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each template word stands, over all documents. As many rows as template words reach the driver."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text in utf8(b.column(0)):
                n.update(vocabulary.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), count, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


NAMED = frozenset(w.encode() for w in NAMES)


class TemplateIndex:
    """Prefix index of the templates under a global order of their words, rarest first."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be over 0 and at most 1")
        words = {w for _, t in templates for w in words_of(t.encode())}
        self.rank = {w: i for i, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = []  # (label, words, least overlap)
        self.spans = []  # words that a block may take
        self.named = []  # words that name the licence
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}  # word -> (template, position)
        self.names = names = {i: w for w, i in self.rank.items()}
        for label, t in templates:
            order = sorted({self.rank[w] for w in words_of(t.encode())})
            if not order:
                continue
            least = max(1, math.ceil(threshold * len(order) - 1e-9))
            for position, r in enumerate(order[: len(order) - least + 1]):
                self.prefix.setdefault(names[r], []).append((len(self.templates), position))
            self.templates.append((label, frozenset(names[r] for r in order), least))
            self.spans.append(math.ceil(len(words_of(t.encode())) / threshold - 1e-9))
            self.named.append(frozenset(names[r] for r in order) & NAMED)
        self.vocabulary = words

    def candidates(self, block: set[bytes]) -> list[int]:
        """The templates that pass the prefix, length and positional filters, in their order."""
        if self.prefix.keys().isdisjoint(block):
            return []
        order = sorted(self.rank[w] for w in block if w in self.rank)
        passed: set[int] = set()
        seen: set[int] = set()
        for at, r in enumerate(order):
            for t, position in self.prefix.get(self.names[r], ()):
                if t in seen:
                    continue
                seen.add(t)
                _, words, least = self.templates[t]
                # the first word that both hold: what they share stands behind it in both
                if self.named[t] <= block and len(block) >= least and min(len(words) - position, len(order) - at) >= least:
                    passed.add(t)
        return sorted(passed)

    def matches(self, block: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block holds far enough."""
        found = []
        for t in self.candidates(block):
            _, words, least = self.templates[t]
            shared = len(words & block)
            if shared >= least:
                found.append((t, shared / len(words)))
        return found

    def windows(self, words: list[bytes], starts: list[int]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of runs over several lines, or within a line that is too long, that hold a template far enough.

        starts: the first word of every line. Of runs of one template that overlap, the fullest counts, the first of those.
        """
        found = []
        present = self.vocabulary.intersection(words)
        # the prefix filter, on the whole text
        for t in sorted({t for w in self.prefix.keys() & present for t, _ in self.prefix[w]}):
            _, own, least = self.templates[t]
            if len(own & present) < least or not self.named[t] <= present:
                continue
            at = [i for i, w in enumerate(words) if w in own]
            held: Counter = Counter()
            low, best = 0, None
            for i in at:
                held[words[i]] += 1
                while i - at[low] >= self.spans[t] or held[words[at[low]]] > 1 and at[low] < i:
                    held[words[at[low]]] -= 1
                    if not held[words[at[low]]]:
                        del held[words[at[low]]]
                    low += 1
                a = at[low]
                if len(held) >= least and self.named[t] <= held.keys() and self._own_block(t, a, i, starts, len(words)):
                    if best and a >= best[2]:
                        found.append(best)
                        best = None
                    if not best or len(held) / len(own) > best[3]:
                        best = (t, a, i + 1, len(held) / len(own))
            if best:
                found.append(best)
        return found

    def _own_block(self, t: int, a: int, b: int, starts: list[int], end: int) -> bool:
        """Whether words a to b lie in several lines, or in one that is longer than a block of the template."""
        k = bisect_right(starts, a)
        after = starts[k] if k < len(starts) else end
        return b >= after or after - starts[k - 1] > self.spans[t]

    def blocks(self, text: bytes, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of all lines and runs, less those that a closer notice explains."""
        found, starts, at = [], [], 0
        for line in text.split(b"\n"):
            own = words_of(line)
            if own:
                starts.append(at)
                if len(own) <= max(self.spans):
                    found += [(t, at, at + len(own), share) for t, share in self.matches(set(own)) if len(own) <= self.spans[t]]
                at += len(own)
        if len(starts) > 1 or at > min(self.spans):
            lines = list(found)
            found += [w for w in self.windows(words, starts) if not any(w[0] == t and w[1] < b and a < w[2] for t, a, b, _ in lines)]
        if len(found) < 2:
            return found
        shared = [self.templates[t][1].intersection(words[a:b]) for t, a, b, _ in found]

        def closer(k: int, m: int) -> bool:
            (t, a, b, x), (u, c, d, y) = found[k], found[m]
            if self.templates[t][0] == self.templates[u][0] or a >= d or c >= b:
                return False
            return shared[k] < shared[m] or shared[k] == shared[m] and x < y

        return [f for k, f in enumerate(found) if not any(closer(k, m) for m in range(len(found)))]


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str, int]]:
    """(start, label, number of words) of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        want = words_of(phrase.encode())
        rare = max(range(len(want)), key=lambda i: len(want[i]))
        at = -1
        n = len(want)
        try:
            while True:
                at = words.index(want[rare], at + 1)
                start = at - rare
                if start >= 0 and words[start : start + n] == want:
                    found.append((start, label, n))
        except ValueError:
            pass
    return sorted(found)


MATCH = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))
SCHEMA = "doc_id long, n_words long, matches array<struct<kind:string,label:string,start:long,words:long,containment:double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_words, matches.

    A match is a phrase's place (kind phrase, containment 1) or a line or run that holds `threshold` of a template's words (kind
    block): its label, first word, number of words and containment. A null text counts as empty. Null or repeated ids are
    scanned row by row, texts of any length whole; further columns are not read; an empty table gives an empty one.
    """
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, template_frequencies(docs, templates, text_col), threshold))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        prefix = held.prefix.keys()
        for b in batches:
            counts, out = [], []
            for text in utf8(b.column(1)):
                words = words_of(text)
                counts.append(len(words))
                found = [{"kind": "phrase", "label": label, "start": s, "words": n, "containment": 1.0} for s, label, n in phrase_places(words, phrases)]
                if text and not prefix.isdisjoint(words):
                    found += [{"kind": "block", "label": held.templates[t][0], "start": a, "words": b - a, "containment": share} for t, a, b, share in held.blocks(text, words)]
                out.append(found)
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(out, MATCH)], ["doc_id", "n_words", "matches"])

    return map_batches(rows, scan, SCHEMA)
