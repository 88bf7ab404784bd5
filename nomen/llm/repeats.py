"""Removal of repeated passages: confirmed passages are compiled into sharded Aho-Corasick automata, and documents are
streamed through them.

A window is ``WINDOW`` consecutive words of one document; a word goes if any window that covers it stands
anywhere else (in the same document too).

1. Anchors.  Of every GUARD consecutive hashes of GRAM words the least is an anchor, so each window has one that
   depends on the window's words alone.  Anchors that occur once rule their windows out.  Recurring anchors
   are kept as a bitmap of fixed size (``BITMAP_BITS``); on very large inputs it fills up and rules out less,
   and costs time but no result.
2. Confirming.  Documents with windows left are written in groups of a few megabytes.  A group sends each distinct
   96-bit window hash once to the bucket of its anchor, with a flag if it has it twice, so that a passage of a third of
   all documents is one entry per group and window.  Of the groups that hold a recurring window the first lends it: only
   that one is told (a bit per window), and the bucket lists which groups want what from which lender.
3. Passages.  A lender joins the windows that it lends to passages, in pieces of a document or ``SPAN`` window starts, and each
   piece goes once to each group that wants it, as text.
4. Locating.  A group knows nothing of where passages stand in it.  The passages it was sent are cut into tiles of
   ``TILE`` words, so that any window of a passage holds a whole tile; the tiles are compiled into Aho-Corasick automata
   over word numbers (shards of at most ``SHARD_WORDS`` words), all documents of the group are streamed through them, and
   each tile found is extended word by word on both sides.  Matches of a window or more are what is removed.

A place that matches a passage elsewhere is a repetition by its words, not only by hashes.  At the passage's own place
the match covers what its windows cover.

Null texts have no words; repeated rows and repeated ids are documents of their own, so rows with equal texts of a
window or more lose all words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm import _words
from nomen.llm._shared import bucketed, materialise

WINDOW, GRAM = 35, 16
GUARD = WINDOW - GRAM + 1
BITMAP_BITS = 1 << 27
GROUP_BYTES = 4 << 20
BUCKET_WINDOWS = 1 << 18  #: a bucket is held by one task
SHARD_WORDS = 400_000
TILE = (WINDOW + 1) // 2
SPAN = 512
MATCHES_AT_ONCE = 1 << 19
_SECOND = np.uint64(0x9FB21C651E98DF25)


def anchors(table: _words.WordTable) -> np.ndarray:
    """For each window (by first word; only those inside one document count) the position of its anchor."""
    n = max(0, len(table) - WINDOW + 1)
    grams = table.grams(GRAM)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, GUARD):
        other = grams[j : j + n]
        lower = other <= least
        least = np.where(lower, other, least)
        at = np.where(lower, np.arange(j, j + n), at)
    return at


def _tables(column: pa.Array, most: int = _words.CHUNK_BYTES) -> Iterator[tuple[int, int, _words.WordTable]]:
    return _words.tables(column, _words.SPACE_SEPARATED, False, most)


def _distinct(values: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of distinct values in sorted order, their counts, and each value's number among them."""
    order = np.lexsort((second, values)) if second is not None else np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if second is not None:
        new[1:] |= second[order][1:] != second[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return first, np.bincount(number, minlength=len(first)), number


def _repeated(blobs: list[bytes], flags: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the entries of all blobs: first hash, blob, the first entry of the same hash, and whether the hash occurs twice."""
    sizes = np.array([len(b) // width for b in blobs])
    first = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, sizes)])
    second = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(blobs, sizes)]) if width == 12 else None
    twice = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags, sizes)])
    lead, _, number = _distinct(first, second)
    total = np.bincount(number, weights=1 + twice)
    return first, np.repeat(np.arange(len(blobs)), sizes), lead[number], total[number] >= 2


def recurring_anchors(docs: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap of anchors that occur twice at least; ``docs``: (id, text)."""
    size = bits.bit_length() - 1
    power = min(size - 3, max(4, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))  # buckets in proportion to the input

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t in _tables(batch.column(1), GROUP_BYTES // 2):
                full = t.whole(WINDOW)
                if not full.any():
                    continue
                at = np.unique(anchors(t)[full])
                found = t.grams(GRAM)[at]
                first, counts, _ = _distinct(found)
                values, twice = found[first], counts > 1
                bucket = (values >> np.uint64(64 - power)).astype(np.int64)
                edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
                spans = list(zip(edge[:-1], edge[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for a, b in spans], pa.binary())], names=["bucket", "hashes", "twice"])

    def slice_of(table: pa.Table) -> pa.Table:
        first, _, _, again = _repeated(table["hashes"].to_pylist(), table["twice"].to_pylist(), 8)
        own = np.zeros(1 << (size - power), bool)
        own[((first[again] >> np.uint64(64 - size)) & np.uint64((1 << (size - power)) - 1)).astype(np.int64)] = True
        return pa.table({"bucket": table["bucket"].slice(0, 1), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    slices = docs.mapInArrow(collect, "bucket int, hashes binary, twice binary").groupBy("bucket").applyInArrow(slice_of, "bucket int, bits binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    step = len(bitmap) >> power
    for row in slices.toLocalIterator():  # always bits / 8 bytes in all
        bitmap[row["bucket"] * step : (row["bucket"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def _left(table: _words.WordTable, bitmap: np.ndarray) -> np.ndarray:
    """Windows (first words) whose anchor recurs."""
    full = table.whole(WINDOW)
    if not full.any():
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    place = (table.grams(GRAM) >> shift).astype(np.int64)
    recurs = (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
    return np.flatnonzero(full & recurs[anchors(table)].astype(bool))


def _whole_text(data: bytes, digest: bool) -> tuple[int, str]:
    words = data.split()
    return len(words), _kept(b" ".join(words), digest)


def _kept(data: bytes, digest: bool) -> str:
    return hashlib.sha256(data).hexdigest() if digest else data.decode("utf-8")


def _windows(table: _words.WordTable, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the windows at these words."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    second = table.grams(WINDOW, _words.mix(table.hash + _SECOND))
    return table.grams(WINDOW)[at], (second[at] >> np.uint64(32)).astype(np.uint32)


def _bucket(first: np.ndarray, buckets: int) -> np.ndarray:
    return ((first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _group_table(texts: list[bytes]) -> _words.WordTable:
    return _words.WordTable(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), _words.SPACE_SEPARATED, False)


def _texts(packed: bytes, sizes: list[int]) -> list[bytes]:
    data = zstandard.decompress(packed)
    ends = np.cumsum([0, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Questions:
    """The distinct windows of a group in the order in which they are asked: by bucket, then by hash."""

    def __init__(self, table: _words.WordTable, bitmap: np.ndarray, buckets: int):
        at = _left(table, bitmap)
        first, second = _windows(table, at)
        one, counts, _ = _distinct(first, second)
        bucket = _bucket(table.grams(GRAM)[anchors(table)[at[one]]], buckets) if len(at) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        one = one[order]
        self.bucket, self.first, self.second, self.start = bucket[order], first[one], second[one], at[one]
        self.twice = counts[order] > 1
        # pieces are numbered in 16 bits: a group has less than 65,535 documents with a window, as its bytes are bounded
        size = max(SPAN, -(-len(table) // max(1, 65_535 - len(table.counts))))
        doc, base = table.doc[self.start], np.cumsum(-(-table.counts // size))
        self.piece = base[doc] - -(-table.counts[doc] // size) + (self.start - table.first[doc]) // size
        edge = np.append(np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])), len(one)).tolist()
        self.spans = [(i, j) for i, j in zip(edge[:-1], edge[1:]) if j > i]


def passages(starts: np.ndarray, doc: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece and word range (start, end) of the passages that windows at these sorted words make up; a passage
    lies in one document and in one piece."""
    apart = (starts[1:] > starts[:-1] + WINDOW) | (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
    new = np.append(np.ones(min(1, len(starts)), bool), apart)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(starts))[: len(head)] - 1
    return piece[head], starts[head], starts[last] + WINDOW


def locate(docs: list[list[bytes]], phrases: list[bytes], shard_words: int = SHARD_WORDS) -> list[np.ndarray]:
    """For each document (a list of words) which words lie in ``WINDOW`` or more consecutive words that also stand in one
    of the phrases (words joined by a space)."""
    number: dict[bytes, int] = {}
    known: list[int] = [-1]
    places: dict[tuple, list[int]] = {}
    for phrase in sorted(set(phrases)):
        ids = [number.setdefault(w, len(number) + 1) for w in phrase.split(b" ")]
        for j in range(0, len(ids) - TILE + 1, TILE):
            places.setdefault(tuple(ids[j : j + TILE]), []).append(len(known) + j)
        known += ids
        known.append(-1)
    stream = [0]  # foreign words and the bounds of documents
    for words in docs:
        stream += [number.get(w, 0) for w in words]
        stream.append(0)
    edges = np.zeros(len(stream) + 1, np.int64)
    p, d, whole = np.array(known), np.array(stream), tuple(stream)
    tiles = list(places.items())
    per_shard = max(1, shard_words // TILE)
    for a in range(0, len(tiles), per_shard):
        shard = tiles[a : a + per_shard]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, (tile, _) in enumerate(shard):
            automaton.add_word(tile, i)
        automaton.make_automaton()
        found = np.array(list(automaton.iter(whole)), np.int64).reshape(-1, 2)
        counts = np.array([len(at) for _, at in shard])
        flat = np.array([y for _, at in shard for y in at], np.int64)
        begin = np.cumsum(counts) - counts
        total = np.cumsum(counts[found[:, 1]])
        lo = 0
        while lo < len(found):  # in blocks, as a tile may stand in many passages
            done = int(total[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + MATCHES_AT_ONCE, side="right")))
            tile, n = found[lo:hi, 1], counts[found[lo:hi, 1]]
            x = np.repeat(found[lo:hi, 0] - TILE + 1, n)
            y = np.repeat(begin[tile] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            _extend(d, p, x, flat[y], edges)
            lo = hi
    hit = np.cumsum(edges[:-1]) > 0
    ends = np.cumsum([1, *(len(words) + 1 for words in docs)]).tolist()
    return [hit[i : j - 1] for i, j in zip(ends[:-1], ends[1:])]


def _extend(d: np.ndarray, p: np.ndarray, x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> None:
    """Grows matches of a tile (at words x of the stream and y of the passages) both ways and marks the bounds of the long
    ones.  No bound of a document equals a word or bound of a passage, so matches end there."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    apart = (x[1:] != x[:-1] + TILE) | (y[1:] != y[:-1] + TILE)
    head = np.flatnonzero(np.append(np.ones(min(1, len(x)), bool), apart))  # tiles in a row are one match
    tail = np.append(head[1:], len(x))[: len(head)] - 1
    lo, hi = x[head].copy(), x[tail] + TILE
    for step, reach in ((-1, lo), (1, hi)):
        alive = np.arange(len(head))
        at, of = (x[head] - 1, y[head] - 1) if step < 0 else (x[tail] + TILE, y[tail] + TILE)
        while len(alive):
            same = d[at] == p[of]
            alive, at, of = alive[same], at[same] + step, of[same] + step
            reach[alive] += step
    long = hi - lo >= WINDOW
    np.add.at(edges, lo[long], 1)
    np.add.at(edges, hi[long], -1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): kept words joined by one space, or with ``digest`` the SHA-256 of that."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(recurring_anchors(docs))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without windows left are finished, and have a negative gid, one per task; the others go into groups."""
        bitmap, part, number = shared.value, TaskContext.get().partitionId(), 0
        group: list[tuple] = []
        size = windows = 0

        def rows(done: list[tuple], packed: tuple | None) -> pa.RecordBatch:
            n = len(done) + (packed is not None)
            columns = [[r[i] for r in done] + [None] * (n - len(done)) for i in range(3)]
            grouped = [[-1 - part if i == 0 else None] * len(done) + ([] if packed is None else [packed[i]]) for i in range(5)]
            ids = batch.schema.field(0).type
            kinds = [ids, pa.int64(), pa.string(), pa.int64(), pa.list_(ids), pa.binary(), pa.list_(pa.int64()), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip([*columns, *grouped], kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "kept", "gid", "ids", "texts", "sizes", "windows"])

        def pack() -> tuple:
            data = zstandard.compress(b"".join([g[1] for g in group]))
            return (part << 32) + number, [g[0] for g in group], data, [len(g[1]) for g in group], windows

        batch = None
        for batch in batches:
            data, offsets = _words.raw(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b, t in _tables(batch.column(1)):
                at = _left(t, bitmap)
                per = np.bincount(t.doc[at], minlength=b - a) if len(at) else np.zeros(b - a, np.int64)
                done = []
                for k in range(a, b):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    if per[k - a]:
                        group.append((ids[k], text))
                        size += len(text)
                        windows += int(per[k - a])
                    else:
                        done.append((ids[k], *_whole_text(text, digest)))
                packed = None
                if size >= GROUP_BYTES:
                    packed = pack()
                    number, group, size, windows = number + 1, [], 0, 0
                yield rows(done, packed)
        if group:
            yield rows([], pack())

    fields = f"id {kind}, n_words long, kept string, gid long, ids array<{kind}>, texts binary, sizes array<long>, windows long"
    # the groups' texts stay in their buckets: at least as many as a join would deal, and in proportion to the input
    stay = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * docs.rdd.getNumPartitions())
    out = bucketed(docs.mapInArrow(split, fields), "groups", "gid", stay)
    done = out.where("gid < 0").select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    groups = out.where("gid >= 0")
    buckets = max(1, -(-(out.agg(F.sum("windows")).first()[0] or 0) // BUCKET_WINDOWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for gid, texts, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                q = Questions(_group_table(_texts(texts, sizes)), bitmap, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(q.bucket[a]) for a, _ in q.spans], pa.int32()),
                        pa.array([gid] * len(q.spans), pa.int64()),
                        pa.array([q.first[a:b].tobytes() + q.second[a:b].tobytes() for a, b in q.spans], pa.binary()),
                        pa.array([np.packbits(q.twice[a:b]).tobytes() for a, b in q.spans], pa.binary()),
                        pa.array([q.piece[a:b].astype(np.uint16).tobytes() for a, b in q.spans], pa.binary()),
                    ],
                    names=["bucket", "gid", "hashes", "twice", "pieces"],
                )

    def answer(table: pa.Table) -> pa.Table:
        """To lenders which windows they lend, and (lender, holder, pieces) of all groups that hold such windows."""
        table = table.sort_by("gid")
        _, blob, lead, again = _repeated(table["hashes"].to_pylist(), table["twice"].to_pylist(), 12)
        piece = np.concatenate([np.frombuffer(x, np.uint16) for x in table["pieces"].to_pylist()]).astype(np.int64)
        gids, bucket, n = table["gid"].to_numpy(), table["bucket"][0].as_py(), len(table)
        lent = again & (lead == np.arange(len(lead)))
        edge = np.searchsorted(blob, np.arange(n + 1))
        lenders = [k for k in range(n) if lent[edge[k] : edge[k + 1]].any()]
        lead = lead[again]
        key = np.unique(((blob[lead] * n + blob[again]) << 16) + piece[lead])
        pair = key >> 16
        cut = np.append(np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), pair[1:] != pair[:-1])), len(key))
        heads, wanted = pair[cut[:-1]], [(key[a:b] & 65_535).tolist() for a, b in zip(cut[:-1], cut[1:])]
        rows = len(lenders) + len(heads)
        return pa.table(
            {
                "gid": pa.array(np.concatenate([gids[lenders], gids[heads // n]]).astype(np.int64), pa.int64()),
                "bucket": pa.array([bucket] * rows, pa.int32()),
                "bits": pa.array([np.packbits(lent[edge[k] : edge[k + 1]]).tobytes() for k in lenders] + [None] * len(heads), pa.binary()),
                "holder": pa.array([None] * len(lenders) + gids[heads % n].tolist(), pa.int64()),
                "pieces": pa.array([None] * len(lenders) + wanted, pa.list_(pa.int32())),
            }
        )

    asked = groups.select("gid", "texts", "sizes").mapInArrow(ask, "bucket int, gid long, hashes binary, twice binary, pieces binary")
    answers = materialise(asked.groupBy("bucket").applyInArrow(answer, "gid long, bucket int, bits binary, holder long, pieces array<int>"), "answers")
    lent = answers.where("bits IS NOT NULL").groupBy("gid").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))
    every = F.array_distinct(F.flatten(F.collect_list("pieces")))  # at most a lender's pieces a bucket
    wanted = answers.where("holder IS NOT NULL").groupBy("gid", "holder").agg(every.alias("pieces"))
    wanted = wanted.select("gid", "holder", F.explode("pieces").alias("piece"))

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for gid, packed, sizes, bits in zip(*(c.to_pylist() for c in batch.columns)):
                texts = _texts(packed, sizes)
                t = _group_table(texts)
                q = Questions(t, bitmap, buckets)
                chosen = np.zeros(len(q.start), bool)
                at = {int(q.bucket[a]): (a, b) for a, b in q.spans}
                for x in bits:
                    a, b = at[x["bucket"]]
                    chosen[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
                order = np.argsort(q.start[chosen])
                starts, piece = q.start[chosen][order], q.piece[chosen][order]
                words = [w for text in texts for w in text.split()]
                phrases: dict[int, list[bytes]] = {}
                for k, a, b in zip(*(x.tolist() for x in passages(starts, t.doc[starts], piece))):
                    phrases.setdefault(k, []).append(b" ".join(words[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([gid] * len(phrases), pa.int64()),
                        pa.array(list(phrases), pa.int32()),
                        pa.array([b"\n".join(x) for x in phrases.values()], pa.binary()),
                    ],
                    names=["gid", "piece", "phrases"],
                )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed, sizes, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                docs = [text.split() for text in _texts(packed, sizes)]
                hits = locate(docs, [phrase for piece in pieces or [] for phrase in piece.split(b"\n")])
                kept = [_kept(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), digest) for words, gone in zip(docs, hits)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, batch.schema.field(0).type.value_type),
                        pa.array([len(words) for words in docs], pa.int64()),
                        pa.array([int(gone.sum()) for gone in hits], pa.int64()),
                        pa.array(kept, pa.string()),
                    ],
                    names=[id_col, "n_words", "n_removed", "kept"],
                )

    lenders = groups.join(lent, "gid").select("gid", "texts", "sizes", "bits")
    pieces = lenders.mapInArrow(lend, "gid long, piece int, phrases binary")
    sent = wanted.join(pieces, ["gid", "piece"]).groupBy(F.col("holder").alias("gid")).agg(F.collect_list("phrases").alias("pieces"))
    rest = groups.join(sent, "gid", "left").select("ids", "texts", "sizes", "pieces").mapInArrow(finish, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")
    return done.unionByName(rest)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p+34], ' ')) AS h FROM p),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS x FROM win JOIN again USING (h)),
g AS (SELECT doc_id, list(x) AS xs, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, string_agg(w[i], ' ' ORDER BY i) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.x = words.i WHERE gone.x IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
