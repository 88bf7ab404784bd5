"""Licence scan by a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template: whole licence texts (files in ``licences``, and the short ones
below) and the notices that stand for a licence.  Each text is streamed through it, giving for each word the longest
template run that ends there (the matching statistics).  All places of a long run in a template are candidates, and the best
chain of runs in the order of text and template is found, where each foreign word between two runs costs GAP_COST words.  A
template is reported when enough of it is covered.  Three fixed phrases give base labels, which always stay.

Words: A-Z lower-cased, then runs of digits, a-z and all characters beyond ASCII.  The automaton is fixed and
small, so the scan is one pass without a shuffle.  Null counts as empty text; empty texts have no words, null
first and last words and score 0; repeated rows give a row each, an empty table none; other columns of the input are
ignored.  A text is handled as a whole in its task; chains take time in proportion to its runs (times a logarithm).
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nomen.llm import _words

# Phrases and labels of the base scan (fixed values)
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and short licences by label.
NOTICES = (
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Whole short licences.
SHORT = (
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty
        of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software""",
    ),
    (
        "bsd",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission this software is provided by the
        copyright holders and contributors as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder
        or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but
        not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
        caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    ),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
        and the author disclaims all warranties with regard to this software including all implied warranties of merchantability
        and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
    ),
    (
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
        or non commercial and by any means""",
    ),
)
#: Labels of the whole texts in the folder ``licences``, by file.
FILES = {
    "Apache-2.0": "apache",
    "Artistic": "artistic",
    "CC0-1.0": "cc0",
    "GPL-2": "gpl",
    "GPL-3": "gpl",
    "LGPL-2.1": "lgpl",
    "LGPL-3": "lgpl",
    "MPL-2.0": "mpl",
}

LEAST_RUN = 4  #: words of a run that counts
GAP_COST = 0.05  #: words that a foreign word inside a chain costs
LEAST_COVER = 0.75  #: share of a template that must be covered


@functools.cache
def all_templates() -> tuple[tuple[str, str], ...]:
    """(label, text) of all templates."""
    folder = Path(__file__).parent / "licences"
    whole = tuple((label, (folder / f"{name}.txt").read_text(encoding="utf-8")) for name, label in sorted(FILES.items()))
    return NOTICES + SHORT + whole


def words_of(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    table = _words.WordTable(data, np.array([0, len(data)]), _words.ALPHANUMERIC, True)
    return [table.data[a:b].tobytes().decode() for a, b in zip(table.start, table.end)]


class SuffixAutomaton:
    """All runs of words of several sequences.

    ``place[state]``: (sequence, word) of every end of the state's run, for runs of LEAST_RUN words or more.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.place: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.place[last].append((k, i))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= LEAST_RUN:
                self.place[self.link[state]] += self.place[state]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.place.append([])
        return len(self.length) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state of parent's run plus word, given that a longer run shares its state."""
        old = self.next[parent][word]
        if self.length[old] == self.length[parent] + 1:
            return old
        new = self._state(self.length[parent] + 1)
        self.next[new] = dict(self.next[old])
        self.link[new], self.link[old] = self.link[old], new
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = new
            parent = self.link[parent]
        return new

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier sequence has this run
            return self._split(last, word)
        new, at = self._state(self.length[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        self.link[new] = 0 if at < 0 else self._split(at, word)
        return new

    def runs(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """Maximal matches (first word, end, state): the matching statistics where the next word doesn't extend them."""
        state = length = 0
        for i, word in enumerate(words):
            if word not in self.next[state]:
                if length >= LEAST_RUN:
                    yield i - length, i, state
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                length = 0
        if length >= LEAST_RUN:
            yield len(words) - length, len(words), state


class _Chains:
    """Runs of one template, as they come in text order, joined into the best chain.

    A Fenwick tree over template places holds the best chain that ends before each; a chain enters it when the text has
    passed its end.
    """

    def __init__(self, size: int):
        self.size = size
        self.tree: list[tuple] = [(-1e18,)] * (size + 1)
        self.waiting: list[tuple] = []  #: (text end, chain)
        self.best: tuple = (0.0, 0, 0, 0)  #: value, words covered, first word, end

    def add(self, a: int, b: int, at: int) -> None:
        """Words a to b stand in the template from ``at`` on; a never falls."""
        while self.waiting and self.waiting[0][0] <= a:
            end, place, value, covered, first = heapq.heappop(self.waiting)
            entry, k = (value + GAP_COST * end, covered, first), place
            while k <= self.size:
                if self.tree[k][0] < entry[0]:
                    self.tree[k] = entry
                k += k & -k
        before, k = (-1e18,), at
        while k > 0:
            before = max(before, self.tree[k])
            k -= k & -k
        n = b - a
        value, covered, first = float(n), n, a
        if before[0] - GAP_COST * a > 0:
            value, covered, first = before[0] - GAP_COST * a + n, before[1] + n, before[2]
        heapq.heappush(self.waiting, (b, at + n, value, covered, first))
        self.best = max(self.best, (value, covered, first, b))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] | None = None, phrases: dict[str, str] = PHRASES):
        templates = all_templates() if templates is None else templates
        self.labels = [label for label, _ in templates]
        split = [words_of(text) for _, text in templates]
        self.sizes = [len(s) for s in split]
        words = sorted({w for s in split for w in s} | {w for p in phrases for w in p.split()})
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashes = _words.WordTable(data, np.array([0, len(data)]), _words.ALPHANUMERIC, True).hash
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        ids = {w: i for i, w in enumerate(words)}
        self.automaton = SuffixAutomaton([[ids[w] for w in s] for s in split])
        self.phrases = [(label, [ids[w] for w in p.split()]) for p, label in phrases.items()]

    def word_ids(self, table: _words.WordTable) -> np.ndarray:
        """Each word's number, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, table.hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == table.hash, self.ids[at], -1)

    def chains(self, runs: list[tuple[int, int, int]]) -> dict[str, tuple[float, int, int]]:
        """Label to (best covered share, first word, end) over its templates.  Runs come in text order."""
        pieces, done = [], 0
        for a, b, state in runs:
            size = b - a
            for k, end in self.automaton.place[state]:
                pieces.append((a, b, end - size + 1, k))
                if a < done < b:  # also without what the run before has
                    pieces.append((done, b, end - size + 1 + done - a, k))
            done = b
        found: dict[int, _Chains] = {}
        for a, b, at, k in sorted(pieces):
            if k not in found:
                found[k] = _Chains(self.sizes[k])
            found[k].add(a, b, at)
        best: dict[str, tuple[float, int, int]] = {}
        for k, chain in found.items():
            _, covered, first, end = chain.best
            best[self.labels[k]] = max(best.get(self.labels[k], (0.0, 0, 0)), (min(1.0, covered / self.sizes[k]), first, end))
        return best

    def scan(self, table: _words.WordTable) -> list[tuple]:
        """A row for each document: words, base places, first, last, base labels, labels, score, spans."""
        ids, doc = self.word_ids(table), table.doc
        docs = len(table.first) - 1
        places: dict[int, list[tuple[int, str]]] = {}
        for label, phrase in self.phrases:
            m = len(ids) - len(phrase) + 1
            if m > 0:
                hit = doc[:m] == doc[len(phrase) - 1 :]
                for i, w in enumerate(phrase):
                    hit &= ids[i : i + m] == w
                for at in np.flatnonzero(hit).tolist():
                    places.setdefault(int(doc[at]), []).append((at - int(table.first[doc[at]]), label))
        # streams of template words, at least LEAST_RUN long: any other word brings the automaton back to its start
        known = ids >= 0
        edge = np.flatnonzero(known[1:] != known[:-1]) + 1 if len(known) else np.zeros(0, int)
        edge = np.unique(np.concatenate([[0], edge, table.first[1:-1], [len(known)]])).astype(int)
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= LEAST_RUN and known[a]:
                base = a - int(table.first[doc[a]])
                runs.setdefault(int(doc[a]), []).extend((base + x, base + y, s) for x, y, s in self.automaton.runs(ids[a:b].tolist()))
        out = []
        for k in range(docs):
            n = int(table.first[k + 1] - table.first[k])
            base, chains = places.get(k, ()), self.chains(runs[k]) if k in runs else {}
            starts = [at for at, _ in base]
            labels = {label for _, label in base}
            more = {label: (a, b) for label, (share, a, b) in chains.items() if share >= LEAST_COVER}
            score = 1.0 if base else max((share for share, _, _ in chains.values()), default=0.0)
            spans = [{"label": label, "first_word": a, "end_word": b} for label, (a, b) in sorted(more.items())]
            names = ",".join(sorted(labels)), ",".join(sorted(labels | set(more)))
            out.append((n, len(base), min(starts, default=None), max(starts, default=None), *names, score, spans))
        return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SCHEMA = """n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,
    spans array<struct<label:string,first_word:long,end_word:long>>"""


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] | None = None,
) -> DataFrame:
    """One row per document: base places and labels, all labels, score, and the covered template spans.

    ``templates``: (label, text) pairs in place of the licences that come with this module.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _default() if templates is None else Scanner(templates)
        for batch in batches:
            rows = [r for _, _, t in _words.tables(batch.column(1), _words.ALPHANUMERIC, True) for r in scanner.scan(t)]
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *_NAMES])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_SCHEMA}")


@functools.cache
def _default() -> Scanner:
    """One scanner per process."""
    return Scanner()
