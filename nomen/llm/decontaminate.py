"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (an item with fewer words, but not none, is one
window).  Document words inside any occurrence of a window are hit.

Both sides are fingerprinted alike: of every ``GUARD`` consecutive hashes of ``GRAM`` words the least (the last of
equals) is kept.  Any shared span of GRAM + GUARD - 1 = WINDOW words has the same kept hash on both sides, so
the join of kept hashes misses no window.  Each joined position is extended to the longest common run, whose words
are compared as text; runs of WINDOW words or more are hits.  Items with fewer words are matched as a whole, by
the hash of all their words.

The benchmark goes to every task only while its text is at most ``broadcast_bytes``, which is measured; a larger
one is joined by gram and then by window (``_large``).  Both ways give the same rows.

Null texts have no words; rows of the benchmark without id take no part; an item id counts once however often
it is repeated; repeated documents give a row each; other columns are ignored.  A text is handled as a whole in its
task, in arrays of about 40 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm import _words
from nomen.llm._shared import materialise, numbered

WINDOW, GRAM = 13, 7
GUARD = WINDOW - GRAM + 1
BROADCAST_BYTES = 32 << 20
SALTS = 8  #: tasks that share the rows of one gram or window

_OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_OUT_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def winnowed(table: _words.WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept grams of all documents of the table."""
    full = table.whole(WINDOW)
    if not full.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = table.grams(GRAM)
    n = len(full)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, GUARD):
        other = grams[j : j + n]
        lower = other <= least
        least = np.where(lower, other, least)
        at = np.where(lower, np.arange(j, j + n), at)
    kept = np.zeros(len(grams), bool)
    kept[at[full]] = True
    where = np.flatnonzero(kept)
    return where, grams[where]


class Benchmark:
    """Words, kept grams and short items of a benchmark."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        encoded = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, encoded)])
        self.table = t = _words.WordTable(np.frombuffer(b"".join(encoded), np.uint8), offsets, _words.ALPHANUMERIC, True)
        at, grams = winnowed(t)
        order = np.argsort(grams, kind="stable")
        self.at, self.grams = at[order], grams[order]
        counts = t.counts
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, WINDOW):
            items = np.flatnonzero(counts == size)
            if len(items):
                hashes = t.grams(size)[t.first[items]]
                order = np.argsort(hashes, kind="stable")
                self.short[size] = hashes[order], items[order]

    def hits(self, docs: _words.WordTable) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and each hit document's items."""
        hit, items = np.zeros(len(docs), bool), {}
        mine = self.table
        where, grams = winnowed(docs)
        lo, hi = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        done: dict[tuple[int, int, int], int] = {}
        for k in np.flatnonzero(hi > lo).tolist():
            p = int(where[k])
            doc = int(docs.doc[p])
            for q in self.at[lo[k] : hi[k]].tolist():
                item = int(mine.doc[q])
                line = (doc, item, p - q)
                if done.get(line, -1) >= p:
                    continue
                a, b = self._extend(docs, doc, p, item, q)
                done[line] = b
                if b - a >= WINDOW and docs.text(a, b) == mine.text(a - p + q, b - p + q):
                    hit[a:b] = True
                    items.setdefault(doc, set()).add(self.ids[item])
        for size, (hashes, owners) in self.short.items():
            grams, full = docs.grams(size), docs.whole(size)
            lo = np.searchsorted(hashes, grams, "left")
            found = full & (hashes[np.minimum(lo, len(hashes) - 1)] == grams)
            for p in np.flatnonzero(found).tolist():
                for k in range(int(lo[p]), len(hashes)):
                    if hashes[k] != grams[p]:
                        break
                    item = int(owners[k])
                    q = int(mine.first[item])
                    if docs.text(p, p + size) == mine.text(q, q + size):
                        hit[p : p + size] = True
                        items.setdefault(int(docs.doc[p]), set()).add(self.ids[item])
        return hit, items

    def _extend(self, docs: _words.WordTable, doc: int, p: int, item: int, q: int) -> tuple[int, int]:
        """The longest run of equal word hashes around positions p and q, as positions of the documents."""
        mine = self.table
        left = min(p - int(docs.first[doc]), q - int(mine.first[item]))
        same = docs.hash[p - left : p][::-1] == mine.hash[q - left : q][::-1]
        a = p - (left if same.all() else int(same.argmin()))
        right = min(int(docs.first[doc + 1]) - p, int(mine.first[item + 1]) - q)
        same = docs.hash[p : p + right] == mine.hash[q : q + right]
        return a, p + (right if same.all() else int(same.argmin()))


def _row(words: int, hit: int, items: set[str]) -> tuple:
    return words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= words


def _small(docs: DataFrame, ids: list[str], texts: list[str], id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*shared.value)
        for batch in batches:
            rows = []
            for _, _, table in _words.tables(batch.column(1), _words.ALPHANUMERIC, True):
                hit, items = bench.hits(table)
                before = np.append(0, np.cumsum(hit))
                n_hit = before[table.first[1:]] - before[table.first[:-1]]
                rows += [_row(n, h, items.get(k, set())) for k, (n, h) in enumerate(zip(table.counts.tolist(), n_hit.tolist()))]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *_OUT_NAMES])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_OUT}")


def _keys(table: DataFrame, lengths: list[int], whole_items: bool) -> DataFrame:
    """(row, size, key, at): kept grams (size 0) and hashes of ``size`` words (of short items: all of theirs), with the word
    that they start at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, t in _words.tables(batch.column(1), _words.ALPHANUMERIC, True):
                at, grams = winnowed(t)
                found = [(at, 0, grams)]
                for size in lengths:
                    full = t.whole(size)
                    if whole_items:
                        full = full & (t.counts == size)[t.doc[: len(full)]]
                    found.append((np.flatnonzero(full), size, t.grams(size)[full]))
                for at, size, grams in found:
                    if len(at):
                        doc = t.doc[at]
                        columns = [batch.column(0).take(pa.array(doc + a)), pa.array(np.full(len(at), size, np.int32))]
                        columns += [pa.array(grams.view(np.int64)), pa.array((at - t.first[doc]).astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, names=["row", "size", "key", "at"])

    return table.mapInArrow(run, f"row {table.schema[0].dataType.simpleString()}, size int, key long, at int")


def _windows(table: DataFrame) -> DataFrame:
    """(row, at, size, hash, words) of texts (row, text, near): the windows at the places in ``near``, with their words as text.

    ``near``: array of (size, at); size 0 stands for all windows of WINDOW words around a gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2).to_pylist()
            for a, b, t in _words.tables(batch.column(1), _words.ALPHANUMERIC, True):
                rows = []
                for k in range(a, b):
                    first, n = int(t.first[k - a]), int(t.counts[k - a])
                    wanted = {(x["at"], x["size"]) for x in places[k] if x["size"]}
                    wanted |= {(p, WINDOW) for x in places[k] if not x["size"] for p in range(max(0, x["at"] - GUARD + 1), min(x["at"], n - WINDOW) + 1)}
                    rows += [(k, p, size, text := t.text(first + p, first + p + size), xxhash.xxh64_intdigest(text)) for p, size in sorted(wanted)]
                if rows:
                    k, p, size, text, digest = zip(*rows)
                    columns = [batch.column(0).take(pa.array(k)), pa.array(p, pa.int32()), pa.array(size, pa.int32())]
                    columns += [pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(text, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "size", "hash", "words"])

    return table.mapInArrow(run, f"row {table.schema[0].dataType.simpleString()}, at int, size int, hash long, words binary")


def _large(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same by shuffles.  Rows are told apart by a number of their own, as ids may repeat.

    Documents look up their kept grams among the benchmark's distinct ones, and then, by text, the windows around those
    that are there among its distinct windows.  So a gram or window that very many items hold is one row there, and
    texts don't travel with pairs.
    """
    docs = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "documents")
    bench = materialise(bench.select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "benchmark")
    mine = materialise(_keys(bench.select("row", "text"), list(range(1, WINDOW)), True), "grams")
    sizes = sorted(r[0] for r in mine.select("size").distinct().collect() if r[0])  # at most WINDOW - 1
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    theirs = salted(_keys(docs.select("row", "text"), sizes, False))
    near = theirs.join(spread(mine.select("size", "key").distinct()), ["size", "key", "salt"], "left_semi")
    near = near.groupBy("row").agg(F.collect_list(F.struct("size", "at")).alias("near"))  # a document's own places
    asked = salted(_windows(docs.join(near, "row").select("row", "text", "near")))

    places = mine.groupBy("row").agg(F.collect_set(F.struct("size", "at")).alias("near"))
    held = _windows(bench.join(places, "row").select("row", "text", "near")).join(bench.select("row", "item_id"), "row")
    windows = materialise(held.groupBy("size", "hash", "words").agg(F.collect_set("item_id").alias("items")), "windows")
    hits = asked.join(spread(windows.select("size", "hash", "words")), ["size", "hash", "words", "salt"])
    hits = materialise(hits.select("row", "at", "size", "hash", "words"), "hits")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    what = hits.select("row", "size", "hash", "words").distinct()
    items = salted(what).join(spread(windows), ["size", "hash", "words", "salt"]).select("row", F.explode("items").alias("item"))
    items = items.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items, rows = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for a, _, t in _words.tables(batch.column(1), _words.ALPHANUMERIC, True):
                for k, n in enumerate(t.counts.tolist()):
                    hit = np.zeros(n, bool)
                    for x in spans[a + k] or ():
                        hit[x["at"] : x["at"] + x["size"]] = True
                    rows.append(_row(n, int(hit.sum()), set(items[a + k] or ())))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *_OUT_NAMES])

    full = docs.join(spans, "row", "left").join(items, "row", "left").select("id", "text", "spans", "items")
    return full.mapInArrow(finish, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, {_OUT}")


def _usable(bench: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """Items (item_id, text) that take part, and about how many bytes they are."""
    found = bench.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    found = found.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    return found, found.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    usable, size = _usable(bench, item_col, item_text_col)
    if size > broadcast_bytes:
        return _large(docs, usable, id_col, text_col)
    rows = sorted((r[0], r[1]) for r in usable.collect())
    return _small(docs, [r[0] for r in rows], [r[1] for r in rows], id_col, text_col)


def keep_clean(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    A small benchmark is looked up in place; with a large one, rows are told apart by a number of their own.  Each row is
    judged by its text alone in both ways.
    """
    usable, size = _usable(bench, item_col, item_text_col)
    if size > broadcast_bytes:
        own, row = numbered(docs, "documents")
        bad = _large(own, usable, row, text_col).where("contaminated").select(F.col(row).alias("_bad"))
        return own.join(bad, own[row] == bad["_bad"], "left_anti").drop(row)
    rows = sorted((r[0], r[1]) for r in usable.collect())
    shared, at = docs.sparkSession.sparkContext.broadcast(rows), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Benchmark([r[0] for r in shared.value], [r[1] for r in shared.value])
        for batch in batches:
            keep: list[bool] = []
            for _, _, table in _words.tables(batch.column(at), _words.ALPHANUMERIC, True):
                hit, _ = found.hits(table)
                before = np.append(0, np.cumsum(hit))
                n_hit = before[table.first[1:]] - before[table.first[:-1]]
                keep += (~((n_hit > 0) & (20 * n_hit >= table.counts))).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ip AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[p:p+12], ' ') AS win FROM ip),
s AS (SELECT DISTINCT size FROM iw),
dp AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, s WHERE len(w) >= size),
hit AS (SELECT dp.doc_id, dp.p, dp.size, iw.item_id FROM dp JOIN iw ON iw.size = dp.size AND iw.win = array_to_string(dp.w[dp.p:dp.p+dp.size-1], ' ')),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
