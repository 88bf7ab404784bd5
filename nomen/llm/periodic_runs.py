"""Periodic runs of words, found on the grammar-compressed text.

A run is a longest stretch of words whose smallest period is ``q`` and that has ``LEAST_LENGTH`` words and ``EXPONENT * q`` at least.

1. Words of a batch of documents get numbers (exactly, by dictionary).  In a run every pair of neighbouring words occurs
   three times or more in its document, so a document is cut where a pair is rarer; only what is left goes on.
2. Re-Pair.  In rounds, pairs of symbols that occur twice in a document are replaced by a nonterminal: in each round all
   pairs that are more frequent than the ones they overlap.  A pair that occurs once never becomes part of a frequent one, so
   texts fall apart into ever shorter pieces.  What no round replaces is joined by a balanced tree, whose nonterminals
   occur once each.
3. Every run crosses the boundary between the two sides of the least nonterminal that holds it.  For each
   nonterminal the runs across its boundary are computed once, at its first place: an equal pair of words
   at distance q beside the boundary names a candidate period, and the stretch of words that equal the word q further is
   extended from there within the nonterminal.
4. Each such stretch is translated to all places at which the nonterminal was made, and stretches of one period that lie in
   another one of that period are merged into it; of stretches with the same ends the smallest period counts.

Null texts have no words, and a null id counts as the empty text; repeated rows are documents of their own; an empty table
gives no rows; other columns are ignored.  A document is handled as a whole in its task; its memory is in proportion
to its words, and its time to words times their logarithm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nomen.llm import _words

LEAST_LENGTH, EXPONENT = 6, 4
BATCH_BYTES = 1 << 20
_CANDIDATES = 1 << 21  #: candidate periods tested at once


def planted(key: object, n: int) -> tuple[int, int] | None:
    """(first word, period) of the stretch that the contract writes into a tenth of the documents of ``n`` words."""
    h = zlib.crc32(("" if key is None else str(key)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _word_numbers(table: _words.WordTable) -> np.ndarray:
    """A number for each word of the table; equal words, and only these, have equal ones."""
    sizes = table.end - table.start
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    inside = np.zeros(len(table.data) + 1, np.int8)
    inside[table.start] += 1
    np.subtract.at(inside, table.end, 1)
    letters = table.data[np.cumsum(inside[:-1]).astype(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pair_numbers(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal (left, right), and how often each occurs."""
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.bincount(number) if len(number) else np.zeros(0, np.int64)


def _chosen(rank: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Which pairs to replace: those with a higher rank than both neighbours; of equal ones in a row every second.

    ``rank[i]`` belongs to the pair of places i and i + 1 (-1: none); ``joint[i]``: pairs i and i + 1 share a symbol.
    """
    n = len(rank)
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    before[1:] = np.where(joint[: n - 1], rank[:-1], -1)
    after[:-1] = np.where(joint[: n - 1], rank[1:], -1)
    good = rank >= 0
    first = np.flatnonzero(good & (before != rank))
    last = np.flatnonzero(good & (after != rank))
    place = np.arange(n) - np.repeat(first, last - first + 1) if good.all() else None
    if place is None:
        place = np.zeros(n, np.int64)
        at = np.flatnonzero(good)
        place[at] = at - first[np.searchsorted(first, at, side="right") - 1]
    # a row of equal ranks is a row of one symbol; it wins as a whole, or not at all
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    wins = np.zeros(len(first), bool)
    if len(first):
        wins = (before[first] < rank[first]) & (after[last] < rank[last])
    return good & wins[np.maximum(row, 0)] & (place % 2 == 0)


class Grammar:
    """Nonterminals of a text: for each the first word, the boundary and the end at its first place, and all its places.

    ``words``: numbers of words; ``doc``: their documents; both in text order.  ``rule``, ``place``: for every occurrence of
    a nonterminal in the derivation of the text, its number and its first word.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self._spans: list[np.ndarray] = []
        self._rules: list[np.ndarray] = []
        self._places: list[np.ndarray] = []
        self._count = 0
        n = len(words)
        # symbols: numbers within a document; start: first word; end
        symbol, start, end = words.astype(np.int64), np.arange(n), np.arange(1, n + 1)
        open_ = np.zeros(n, bool)  # open[i]: may symbol i be paired with the next one?
        if n > 1:
            number, counts = _pair_numbers(doc[:-1] * (int(words.max()) + 1) + words[:-1], words[1:])
            open_[:-1] = (doc[:-1] == doc[1:]) & (counts[number] >= 3)
        self.segment = np.concatenate([[0], np.cumsum(~open_)[:-1]]) if n else np.zeros(0, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        keep = open_ | np.append(False, open_[:-1])
        symbol, start, end, open_ = symbol[keep], start[keep], end[keep], open_[keep]
        self.active = start
        fresh = int(words.max()) + 1 if n else 0
        while len(symbol):
            at = np.flatnonzero(open_)
            left, right = symbol[at], symbol[at + 1]
            number, counts = _pair_numbers(doc[start[at]] * fresh + left, right)
            seen = counts[number]
            open_[at[seen < 2]] = False
            alone = ~open_ & ~np.append(False, open_[:-1])
            done.append((start[alone], end[alone]))
            rank = np.full(len(symbol), -1, np.int64)
            good = seen >= 2
            # equal counts in a scattered order: pairs that rise along the text would be replaced one a round
            scattered = np.argsort(_words.mix(np.arange(len(counts))), kind="stable")
            rank[at[good]] = seen[good] * len(counts) + scattered[number[good]]
            keep = ~alone
            symbol, start, end, open_, rank = symbol[keep], start[keep], end[keep], open_[keep], rank[keep]
            if not len(symbol):
                break
            chosen = np.flatnonzero(_chosen(rank, np.append(open_[1:], False)))
            _, first, rule = np.unique(rank[chosen], return_index=True, return_inverse=True)
            self._add(start[chosen], end[chosen], end[chosen + 1], first, rule)
            symbol[chosen], end[chosen], open_[chosen] = fresh + rule, end[chosen + 1], open_[chosen + 1]
            fresh += len(first)
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            symbol, start, end, open_ = symbol[keep], start[keep], end[keep], open_[keep]
        if done:
            start, end = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(start)
            start, end = start[order], end[order]
        while len(start) > 1:  # the balanced tree over each segment
            segment = self.segment[start]
            new = np.append(True, segment[1:] != segment[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(start)))
            nth = np.arange(len(start)) - np.repeat(first, size)
            head = np.flatnonzero((nth % 2 == 0) & (nth + 1 < np.repeat(size, size)))
            if not len(head):
                break
            all_ = np.arange(len(head))
            self._add(start[head], end[head], end[head + 1], all_, all_)
            end[head] = end[head + 1]
            keep = np.ones(len(start), bool)
            keep[head + 1] = False
            start, end = start[keep], end[keep]
        none = np.zeros(0, np.int64)
        self.spans = np.concatenate(self._spans) if self._spans else np.zeros((0, 3), np.int64)
        self.rule = np.concatenate(self._rules) if self._rules else none
        self.place = np.concatenate(self._places) if self._places else none

    def _add(self, start: np.ndarray, boundary: np.ndarray, end: np.ndarray, first: np.ndarray, rule: np.ndarray) -> None:
        self._spans.append(np.stack([start[first], boundary[first], end[first]], axis=1))
        self._rules.append(rule + self._count)
        self._places.append(start)
        self._count += len(first)


def _extent(words: np.ndarray, a: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The longest stretch [s, e) inside [lo, hi) around the word ``a`` whose words equal those q further on."""
    e, step = a, 16
    while e < hi - q:
        upto = min(e + step, hi - q)
        differs = np.flatnonzero(words[e:upto] != words[e + q : upto + q])
        if len(differs):
            e += int(differs[0])
            break
        e, step = upto, 2 * step
    s, step = a, 16
    while s > lo:
        down = max(s - step, lo)
        differs = np.flatnonzero(words[down:s] != words[down + q : s + q])
        if len(differs):
            s = down + int(differs[-1]) + 1
            break
        s, step = down, 2 * step
    return s, e + q


def _crossing(grammar: Grammar, words: np.ndarray) -> np.ndarray:
    """(nonterminal, first word, end, period) of the stretches across each nonterminal's boundary, at its first place."""
    at = grammar.active
    if not len(grammar.spans) or len(at) < 2:
        return np.zeros((0, 4), np.int64)
    n = len(words)
    pair = np.full(n, -1, np.int64)  # pairs of neighbouring words of one segment
    both = at[:-1][(at[1:] == at[:-1] + 1) & (grammar.segment[at[:-1]] == grammar.segment[at[1:] if len(at) > 1 else at])]
    pair[both], _ = _pair_numbers(grammar.segment[both] * (int(words.max()) + 1) + words[both], words[both + 1])
    held = np.flatnonzero(pair >= 0)
    order = held[np.argsort(pair[held], kind="stable")]
    key = pair[order] * (n + 1) + order  # ascending
    lo, mid, hi = grammar.spans.T
    found: list[tuple[int, int, int, int]] = []

    def search(rule: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> None:
        """Places of the pair at ``own`` from ``low`` up to ``high``; each tells a period."""
        a, b = np.searchsorted(key, pair[own] * (n + 1) + low), np.searchsorted(key, pair[own] * (n + 1) + high)
        size = np.maximum(b - a, 0)
        total = np.cumsum(size)
        cut = 0
        while cut < len(size):
            base = int(total[cut - 1]) if cut else 0
            upto = max(cut + 1, int(np.searchsorted(total, base + _CANDIDATES, side="right")))
            who = np.repeat(np.arange(cut, upto), size[cut:upto])
            other = order[np.arange(len(who)) - np.repeat(total[cut:upto] - size[cut:upto] - base, size[cut:upto]) + a[who]]
            q = np.abs(other - own[who])
            # a stretch of EXPONENT periods has two of them at least on one side: its middle and last words agree too
            x = np.minimum(own[who], other) if right else np.minimum(own[who], other) + 1
            sign = 1 if right else -1
            good = np.ones(len(q), bool)
            for part in (q - 1, q // 2, q // 3):
                y = x + sign * part
                good &= words[y] == words[y + q]
            known, past = -1, []  # of one nonterminal, from small periods to large ones
            rows = np.flatnonzero(good)
            for i in rows[np.lexsort((q[rows], who[rows]))].tolist():
                r, p = int(rule[who[i]]), int(q[i])
                if r != known:
                    known, past = r, []
                if any(p % p0 == 0 and p <= room for p0, room in past):
                    continue
                s, e = _extent(words, int(x[i]), p, int(lo[r]), int(hi[r]))
                if s < mid[r] < e and e - s >= max(LEAST_LENGTH, EXPONENT * p):
                    found.append((r, s, e, p))
                    past.append((p, (e - s) // 2))
            cut = upto

    all_ = np.arange(len(lo))
    inside = pair[np.minimum(mid, n - 1)] >= 0
    r = all_[inside & (mid < hi - 1)]
    search(r, mid[r], mid[r] + 1, mid[r] + np.maximum((hi[r] - mid[r]) // 2, 1) + 1, True)
    inside = pair[np.maximum(mid - 2, 0)] >= 0
    r = all_[inside & (mid > lo + 1)]
    search(r, mid[r] - 2, mid[r] - 2 - np.maximum((mid[r] - lo[r]) // 2, 1), mid[r] - 2, False)
    return np.array(found, np.int64).reshape(-1, 4)


def runs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(first word, end, period) of all runs of a text of several documents, by start, then period."""
    grammar = Grammar(words, doc)
    found = _crossing(grammar, words)
    if not len(found):
        return np.zeros((0, 3), np.int64)
    found = np.unique(found, axis=0)
    # all places of these nonterminals
    with_runs = np.unique(found[:, 0])
    used = np.isin(grammar.rule, with_runs)
    rule, place = grammar.rule[used], grammar.place[used]
    order = np.argsort(rule, kind="stable")
    rule, place = rule[order], place[order]
    a, b = np.searchsorted(rule, found[:, 0]), np.searchsorted(rule, found[:, 0], side="right")
    size = b - a
    who = np.repeat(np.arange(len(found)), size)
    shift = place[np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)] - grammar.spans[found[who, 0], 0]
    start, end, q = found[who, 1] + shift, found[who, 2] + shift, found[who, 3]
    # merge: what lies in another stretch of its period goes
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    reach = np.maximum.accumulate(end + q * (len(words) + 1))  # periods ascend, so none reaches into the next
    alone = np.append(True, (end + q * (len(words) + 1))[1:] > reach[:-1])
    start, end, q = start[alone], end[alone], q[alone]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    out = np.stack([start[least], end[least], q[least]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _report(docs: DataFrame, id_col: str, text_col: str, plant: bool, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, t in _words.tables(batch.column(1), _words.SPACE_SEPARATED, False, BATCH_BYTES):
                source = np.arange(len(t))
                for k in range(a, b) if plant else ():
                    lo, hi = int(t.first[k - a]), int(t.first[k - a + 1])
                    if (p := planted(ids[k], hi - lo)) is not None:
                        source[lo + p[0] : hi] = lo + p[0] + np.arange(hi - lo - p[0]) % p[1]
                words = _word_numbers(t)[source] if len(t) else np.zeros(0, np.int64)
                found = runs(words, t.doc)
                gone = dropped(found, len(t))
                edge = np.searchsorted(found[:, 0], t.first)
                data, starts, ends = t.data.tobytes(), t.start[source], t.end[source]
                rows: list[tuple] = []
                for k in range(b - a):
                    lo, hi = int(t.first[k]), int(t.first[k + 1])
                    own = found[edge[k] : edge[k + 1]]
                    length = own[:, 1] - own[:, 0]
                    triples = [(s - lo, n, q) for s, n, q in zip(own[:, 0].tolist(), length.tolist(), own[:, 2].tolist())]
                    best = min(triples, key=lambda x: (-x[1], x[0], x[2]), default=None)
                    if len(own) or source[lo:hi].size and source[hi - 1] != hi - 1:
                        at = lo + np.flatnonzero(~gone[lo:hi])
                        kept = b" ".join([data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
                    else:
                        kept = b" ".join(data[int(t.start[lo]) : int(t.end[hi - 1])].split()) if hi > lo else b""
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in triples)
                    if digest:
                        tail = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                    else:
                        tail = ([{"start": s, "length": n, "period": q} for s, n, q in triples], kept.decode("utf-8"))
                    rows.append((len(triples), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *tail))
                columns = [pa.array([r[i] for r in rows], type_) for i, type_ in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    triple = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = [pa.int64()] * 5 + ([pa.string()] * 2 if digest else [triple, pa.string()])
    names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", *(("runs_sha256", "collapsed_sha256") if digest else ("runs", "collapsed"))]
    last = "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, {last}"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs, collapsed): the longest run of each text, all of them, and the
    text without the words that repeat a run's first period."""
    return _report(docs, id_col, text_col, False, False)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``find_runs`` with SHA-256 digests for the last two columns, on texts with the contract's stretches written in."""
    return _report(docs, id_col, text_col, True, True)
