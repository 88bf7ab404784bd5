"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: a bit is 1 if it is set in more than half of the XXH64 hashes of its
word shingles.  Fingerprints that differ in at most 3 bits are linked, and linked documents form components.

Search.  The 64 bits are cut into segments of 22, 21 and 21 bits, and each segment (padded to 23) is decoded to
the nearest word of the perfect Golay code (23, 12, 7), which has 4096 words and so 12-bit indices.  Segments that differ in
one bit need not decode to the same word, but one of them decodes to a word that the other reaches by flipping
one bit; these are the segment's nearby indices: itself and up to about six.  Three errors over three segments leave one of two
cases (pigeonhole):

* a segment without error and another with one at most: key (exact segment, index of the other), or
* one error in each segment: key (index, index, index).

Stored fingerprints have one key for each case and choice of segments (7), probing ones all combinations of
nearby indices, so a pair within 3 bits always meets in a key.  Keys are joined and the pairs verified with the
full fingerprints.

Skew.  Only distinct fingerprints are searched: exact copies never meet.  In a group of near copies all pairs
could be links; so fingerprints are first linked to the least one in their own keys (a count of links in
proportion to the fingerprints), components of these links are found, and the full join leaves out, before it joins,
what only meets its own component (``meet_across``).

Documents that are alike without being almost equal differ in more than 3 bits; ``keep_dissimilar`` finds them by keys of
the same kind from a wider fingerprint, and verifies them by their shingle sets.

Null texts count as empty; texts without words have fingerprint 0 and are linked like others; a null id takes
part but never names a component (one of null ids alone is null); repeated rows give a row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from nomen.llm._components import components
from nomen.llm._shared import make_room, materialise, merged, numbered
from nomen.llm._words import LOWER, mix
from nomen.llm.collocations import bitmap, has

SHINGLE, BITS, SEED = 3, 3, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  #: first bit and size
BROADCAST_ROWS = 1_000_000  #: row numbers that tasks are sent at once
BLOCK = 1000  #: stored rows of a key that meet probing rows in one piece of work

# the wide fingerprint of documents that are alike by their shingle sets
WORDS, SEGMENT_COUNT = 5, 12
FEATURE = 2  #: words of the shingles that the wide fingerprint is made of: few of them change with a word
TABLES = 42  #: keys of a wide fingerprint
SIZES = "struct<n:int,m:int,hub:bigint,o:int>"  #: of a set: its shingles, those of other sets too, and those of the node ``hub`` too
WORD_BITS = 18  #: bits that the first words of two candidates differ in at most (expected at a similarity of 0.8: 6, 32 by chance)
GROUP_BYTES, BUCKET_HASHES = 4 << 20, 1 << 19  #: text of a group that counts its shingles, hashes of a bucket

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_TO_LOWER = bytes(LOWER)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles."""
    words = [w for w in _SPACE.split((text or "").encode("utf-8").translate(_TO_LOWER)) if w]
    if not words:
        return 0
    line, size = b" ".join(words), np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    m = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[-m:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp: long, the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                found = np.array([fingerprint(t, shingle) for t in batch.column(1).slice(a, 512).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


class Golay:
    """The perfect (23, 12, 7) code.  ``index[w]``: number of the code word nearest to w (at most 3 bits away)."""

    _POLYNOMIAL = 0b101011100011  # generates the code (fixed value)

    def __init__(self) -> None:
        words = np.arange(1 << 12, dtype=np.uint32) << 11
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, np.uint32(self._POLYNOMIAL << (bit - 11)), np.uint32(0))
        words |= rest  # systematic: the upper 12 bits are the index
        self.index = np.zeros(1 << 23, np.uint16)
        bits = [1 << i for i in range(23)]
        errors = [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits for c in bits if a < b < c)]
        for error in errors:
            self.index[words ^ np.uint32(error)] = np.arange(1 << 12, dtype=np.uint16)

    def nearby(self, segment: int, size: int) -> list[int]:
        """Indices of a segment of so many bits and of all segments one bit away."""
        return sorted({int(i) for i in self.index[[segment, *(segment ^ (1 << b) for b in range(size))]]})


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]


_CHOICES = [(i, j) for i in range(3) for j in range(3) if i != j]


def keys(fps: DataFrame, probing: bool) -> DataFrame:
    """(key, fp, part) of fingerprints (fp, part): the 7 stored keys of each, or with ``probing`` all by nearby indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for a in range(0, len(batch), 1000):
                fp = batch.column(0).slice(a, 1000).to_numpy()
                parts = _segments(fp)
                near, owner = [], []
                for part, (_, size) in zip(parts, SEGMENTS):
                    reach = part[:, None] ^ np.append(0, 1 << np.arange(size))[None, :] if probing else part[:, None]
                    reach = np.sort(code.index[reach].astype(np.int64), axis=1)
                    fresh = np.ones(reach.shape, bool)
                    fresh[:, 1:] = reach[:, 1:] != reach[:, :-1]
                    row, col = np.nonzero(fresh)
                    owner.append(row)
                    near.append(reach[row, col])
                out_key, out_row = [], []
                for c, (i, j) in enumerate(_CHOICES):
                    out_key.append((np.int64(c) << 40) | (parts[i][owner[j]] << 12) | near[j])
                    out_row.append(owner[j])
                # all combinations of three indices: for each fingerprint, the product of its three lists
                sizes = [np.bincount(o, minlength=len(fp)) for o in owner]
                first = [np.cumsum(n) - n for n in sizes]
                total = sizes[0] * sizes[1] * sizes[2]
                row = np.repeat(np.arange(len(fp)), total)
                at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
                third, at = at % sizes[2][row], at // sizes[2][row]
                second, one = at % sizes[1][row], at // sizes[1][row]
                out_key.append((np.int64(6) << 40) | (near[0][first[0][row] + one] << 24) | (near[1][first[1][row] + second] << 12) | near[2][first[2][row] + third])
                out_row.append(row)
                rows = np.concatenate(out_row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key)), pa.array(fp[rows]), batch.column(1).slice(a, 1000).take(pa.array(rows))], names=["key", "fp", "part"])

    return fps.select("fp", "part").mapInArrow(run, "key long, fp long, part long")


def meet_across(stored: DataFrame, probing: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, x, b, y, part, part2): rows of ``stored(key, a, x, part)`` and ``probing(key, b, y, part2)`` that share a key and
    not a part.

    Per key the stored rows of the part with most of them (the major part) and the others are kept apart.  A probing row
    of the major part only meets the others, and a key with one part meets nothing from it, so that rows of one group
    never meet each other, however many have the key.  What remains is cut into blocks of ``block`` stored rows.
    """
    per = stored.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("key").agg(
        F.max(F.struct("n", F.col("part").alias("major"))).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")
    )
    keys = totals.select("key", "top.major", "parts", F.ceil(F.col("top.n") / block).cast("int").alias("b1"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("b0"))
    meets = lambda flag, many: F.transform(F.sequence(F.lit(0), F.col(many) - 1), lambda i: F.struct(F.lit(flag).alias("of"), i.alias("salt")))
    none = F.array().cast("array<struct<of:boolean,salt:int>>")
    to = F.concat(F.when(F.col("part2") != F.col("major"), meets(True, "b1")).otherwise(none), F.when(F.col("parts") > 1, meets(False, "b0")).otherwise(none))
    alive = merged(probing, keys, "key").select("key", "b", "y", "part2", F.explode(to).alias("t")).select("key", "b", "y", "part2", "t.of", "t.salt")
    of = F.col("part") == F.col("major")
    salt = F.pmod(F.xxhash64("a"), F.when(of, F.col("b1")).otherwise(F.col("b0"))).cast("int")
    dealt = merged(stored, keys, "key").select("key", "a", "x", "part", of.alias("of"), salt.alias("salt"))
    return merged(dealt, alive, ["key", "of", "salt"]).where("part <> part2").select("a", "x", "b", "y", "part", "part2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id): component_id is the least id that links reach."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"the segments cover up to {BITS} differing bits")
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits

    # links to the least fingerprint of each key: at most 7 for each fingerprint
    stored = materialise(keys(distinct.select("fp", F.col("fp").alias("part")), False).drop("part"), "stored")
    lead = stored.groupBy("key").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "lead")
    stars = merged(stored, lead, "key").where(close("fp", "lead") & (F.col("fp") != F.col("lead"))).select("fp", "lead").distinct()
    part = components(stars).select(F.col("node").alias("fp"), F.col("component").alias("part"))
    parted = materialise(merged(distinct, part, "fp", "left").select("fp", "least", F.coalesce("part", "fp").alias("part")), "parted")

    # all other links: between fingerprints that are not in one part yet
    links = cross_links(parted).where(close("x", "y")).select("part", "part2").distinct()
    joined = components(links).select(F.col("node").alias("part"), "component")
    of = materialise(merged(parted, joined, "part", "left").select("fp", "least", F.coalesce("component", "part").alias("component")), "classes")
    best = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return merged(prints, merged(of, best, "component").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def cross_links(parted: DataFrame) -> DataFrame:
    """Pairs of fingerprints (fp, part) of different parts that share a key, before their distance is tested."""
    mine = keys(parted, False).select("key", F.col("fp").alias("a"), F.col("fp").alias("x"), "part")
    theirs = keys(parted, True).select("key", F.col("fp").alias("b"), F.col("fp").alias("y"), F.col("part").alias("part2"))
    return meet_across(mine, theirs)


# -- documents with a similarity of 0.8 or more


def _sets(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles of a text."""
    words = [w for w in _SPACE.split((text or "").encode("utf-8").translate(_TO_LOWER)) if w]
    if not words:
        return np.zeros(0, np.uint64)
    line, size = b" ".join(words), np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    starts, m = ends - size, max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[-m:].tolist())], np.uint64))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The WORDS 64-bit words of a set's wide fingerprint: its bits are majorities over independent hashes of the shingles."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.stack([mix(hashes[at : at + (1 << 14)] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(WORDS)], axis=1)
        ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def shingle_prints(docs: DataFrame, shingle: int, feature: int = FEATURE) -> DataFrame:
    """(row, d1, d2, fp: binary) of docs (row, text): a digest of the shingle set, and the wide fingerprint of the set of
    shorter shingles.  A changed word breaks ``shingle`` of the long ones and ``feature`` of the short ones, so that
    documents whose long shingles are alike differ in fewer bits of the short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for a in range(0, len(batch), 512):
                texts = batch.column(1).slice(a, 512).to_pylist()
                sets = [_sets(t, shingle) for t in texts]
                digest = np.array([[xxhash.xxh64_intdigest(x.tobytes(), k) for k in (1, 2)] for x in sets], np.uint64).view(np.int64)
                prints = [wide_print(_sets(t, feature)).tobytes() for t in texts]
                columns = [batch.column(0).slice(a, 512), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "d1", "d2", "fp"])

    return docs.mapInArrow(run, "row long, d1 long, d2 long, fp binary")


def wide_keys(nodes: DataFrame, probing: bool) -> DataFrame:
    """(key, node, word, part, at) of nodes (node, fp, part, at: sizes).

    The fingerprint is cut into segments of 23 bits.  Each of TABLES keys joins the Golay index of one segment and 12
    bits of another as they are; with ``probing`` the segment takes all its nearby indices in turn.
    """
    schema = f"key long, node long, word long, part long, at {SIZES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, power = Golay(), 1 << np.arange(23)
        for batch in batches:
            for a in range(0, len(batch), 1000):
                rows = batch.slice(a, 1000)
                fp = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(len(rows), 8 * WORDS)
                bits = np.unpackbits(fp, axis=1)
                parts = [bits[:, 23 * i : 23 * i + 23].astype(np.int64) @ power for i in range(SEGMENT_COUNT)]
                near, owner = [], []
                for part in parts:
                    reach = part[:, None] ^ np.append(0, power)[None, :] if probing else part[:, None]
                    reach = np.sort(code.index[reach].astype(np.int64), axis=1)
                    fresh = np.ones(reach.shape, bool)
                    fresh[:, 1:] = reach[:, 1:] != reach[:, :-1]
                    row, col = np.nonzero(fresh)
                    owner.append(row)
                    near.append(reach[row, col])
                out_key, out_row = [], []
                for t in range(TABLES):
                    i = t % SEGMENT_COUNT
                    other = (i + 1 + t // SEGMENT_COUNT) % SEGMENT_COUNT
                    exact = (parts[other] >> (3 * t % 12)) & 0xFFF
                    out_key.append((np.int64(t) << 24) | (near[i] << 12) | exact[owner[i]])
                    out_row.append(owner[i])
                at = np.concatenate(out_row)
                word = np.ascontiguousarray(fp[:, :8]).view(np.int64)[:, 0]
                take = pa.array(at)
                columns = [pa.array(np.concatenate(out_key)), rows.column(0).take(take), pa.array(word[at]), *(rows.column(i).take(take) for i in (2, 3))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "word", "part", "at"])

    return nodes.select("node", "fp", "part", "at").mapInArrow(run, schema)


def shared_counts(texts: DataFrame, shingle: int, group_bytes: int = GROUP_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """(row, n, m) of texts (row, text): the size of the shingle set, and how many of its shingles another set holds too.

    Each group of a few megabytes of text sends every hash once, to its bucket, with the first set that has it, or marked if two
    different sets have it.  Buckets tell groups how many shingles of a set no other set holds.  Hashes count by the bits of
    their bucket and 32 more: two that are taken for one make ``m`` larger.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (size // 6 // bucket_hashes).bit_length())
    fields = "bucket long, gid long, hashes binary, sets binary, twice binary, places binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = np.array([len(t or "") for t in batch.column(1).to_pylist()])
            total, a = np.cumsum(lengths), 0
            while a < len(batch):
                b = max(a + 1, min(a + 30_000, int(np.searchsorted(total, total[a] - lengths[a] + group_bytes, side="right"))))
                yield group((part << 32) + number, batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False), batch.column(1).slice(a, b - a).to_pylist())
                number, a = number + 1, b

    def group(gid: int, row: np.ndarray, column: list[str | None]) -> pa.RecordBatch:
        place, at, sets, own = np.zeros(len(row), np.uint16), {}, [], []
        n = np.zeros(len(row), np.uint32)
        for k, text in enumerate(column):
            found = _sets(text, shingle)
            digest = xxhash.xxh64_intdigest(found.tobytes(), 1)
            if digest not in at:  # equal sets of a group are one
                at[digest] = len(sets)
                sets.append(found)
                own.append(digest & 0xFFFFFFFF)
            place[k], n[k] = at[digest], len(found)
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        twice = np.diff(np.append(first, len(hashes))) > 1
        hashes, owner = hashes[first], owner[first]
        digest, low = np.array(own, np.uint32)[owner], ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist() if len(bucket) else [0]
        spans = list(zip(edge[:-1], edge[1:]))
        cut = lambda x: [x[i:j].tobytes() for i, j in spans]
        columns = [
            [*(int(bucket[i]) for i, _ in spans), -1 - gid],  # the last row is for the group itself, and no bucket's
            [gid] * (len(spans) + 1),
            [*cut(low), row.astype(np.int64).tobytes()],
            [*cut(digest), n.tobytes()],
            [*cut(twice), b""],
            [*cut(owner), place.tobytes()],
        ]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "gid", "hashes", "sets", "twice", "places"])

    def answer(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.select(["gid", "hashes", "sets", "places"])
        blobs = table["hashes"].to_pylist()
        read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        low, own, twice, place = np.frombuffer(b"".join(blobs), np.uint32), read("sets", np.uint32), read("twice", bool), read("places", np.uint16)
        order = np.argsort(low, kind="stable")
        new = np.append(True, low[order][1:] != low[order][:-1])
        head, own = np.flatnonzero(new), own[order]
        alone = (np.minimum.reduceat(own, head) == np.maximum.reduceat(own, head)) & ~np.logical_or.reduceat(twice[order], head)
        single = np.empty(len(low), bool)
        single[order] = alone[np.cumsum(new) - 1]
        ends = np.cumsum([0, *(len(x) // 4 for x in blobs)]).tolist()
        out: tuple[list, list] = ([], [])
        for i, j in zip(ends[:-1], ends[1:]):
            many = np.bincount(place[i:j][single[i:j]])
            have = np.flatnonzero(many)
            out[0].append(have.astype(np.uint16).tobytes())
            out[1].append(many[have].astype(np.uint32).tobytes())
        return pa.table({"gid": table["gid"], "hashes": pa.nulls(len(blobs), pa.binary()), "sets": pa.array(out[1], pa.binary()), "places": pa.array(out[0], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        single, me = np.zeros(1 << 16, np.int64), None
        for rows, sets, places in zip(*(table[c].to_pylist() for c in ("hashes", "sets", "places"))):
            if rows is None:
                single[np.frombuffer(places, np.uint16)] += np.frombuffer(sets, np.uint32)
            else:
                me = np.frombuffer(rows, np.int64), np.frombuffer(sets, np.uint32).astype(np.int64), np.frombuffer(places, np.uint16)
        row, n, place = me
        return pa.table({"row": row, "n": n.astype(np.int32), "m": (n - single[place]).astype(np.int32)})

    asked = texts.select("row", "text").mapInArrow(ask, fields)
    told = asked.groupBy("bucket").applyInArrow(answer, "gid long, hashes binary, sets binary, places binary")
    return told.groupBy("gid").applyInArrow(total, "row long, n int, m int")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) with the number of shingles that ``both`` sets have and whether they are ``linked`` by the similarity;
    without those whose sizes rule it out.  ``texts``: (node, text).  Texts stay where they are: the nodes of pairs are known to all tasks as a bitmap of fixed size, and a false positive costs time and no result."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            number = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            kept = batch.filter(pa.array(has(shared.value, number)))
            for at in range(0, len(kept), 256):
                sets = [_sets(t, shingle).tobytes() for t in kept.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([kept.column(0).slice(at, 256), pa.array(sets, pa.binary())], names=["node", "hashes"])

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64))], names=["h"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized, linked, common = [], [], []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                sized.append(min(len(x), len(y)) >= similarity * max(len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if sized[-1] else 0
                linked.append(both >= similarity * (len(x) + len(y) - both))
                common.append(both)
            columns = [*batch.select(names).columns, pa.array(common, pa.int32()), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "both", "linked"]).filter(pa.array(sized, pa.bool_()))

    names = pairs.columns
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    shared = pairs.sparkSession.sparkContext.broadcast(bitmap(need.mapInArrow(mixed, "h long")))
    sets = materialise(texts.select("node", "text").mapInArrow(hashes, "node long, hashes binary"), "shingles")
    # a node of very many pairs is given to several tasks
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 500).cast("int").alias("salts"))
    dealt = merged(pairs, salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int")).drop("salts")
    mine = sets.select(F.col("node").alias("a"), F.col("hashes").alias("sa"))
    theirs = merged(sets.select(F.col("node").alias("b"), F.col("hashes").alias("sb")), salts, "b").select("b", "sb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = merged(merged(dealt, mine, "a"), theirs, ["b", "salt"]).select(*names, "sa", "sb")
    return met.mapInArrow(test, StructType([*pairs.schema.fields, StructField("both", IntegerType()), StructField("linked", BooleanType())]))


def similar_groups(docs: DataFrame, row_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, group): rows of ``docs`` (``row_col``: a distinct long) linked by a Jaccard similarity of their word shingles.

    Candidates come from the keys of wide fingerprints, and every link is verified by the shingle sets themselves, so no
    group is wrong; a pair is missed if it shares no key (README: measured recall).  Rows with equal sets are one node.  As
    in ``near_duplicates``, nodes are linked to one of each key first, and other candidates only count
    between parts: the nearest few of each node and part, then those that are left.

    Copies of one base with changes of their own, too many to be linked, would be candidates in all pairs.  What rules
    most of them out loses no link: shingles that no other set has are in no intersection (``shared_counts``); of two
    nodes that were compared with one lead, what they can have in common is bounded (``_may_reach``); and nodes that
    cannot be more similar to any node than the lead that they are linked to leave the search to that one.
    """
    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    prints = materialise(shingle_prints(texts, shingle), "prints")
    same = prints.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.first("fp").alias("fp"))
    nodes = materialise(same, "nodes")
    member = merged(prints, nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("row", "node")
    text_of = texts.withColumnRenamed("row", "node")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= WORD_BITS

    # sets of which too few shingles are shared with any other set have no link
    counts = shared_counts(texts, shingle).withColumnRenamed("row", "node")
    linkable = merged(nodes, counts, "node").where((F.col("n") > 0) & (F.col("m") >= similarity * F.col("n") - 1e-6)).select("node", "fp", "n", "m")
    linkable = materialise(linkable, "linkable")
    sizes = lambda hub, o: F.struct("n", "m", hub.alias("hub"), o.alias("o")).cast(SIZES)

    # links to the node of each key with the least share of shingles of its own: of copies with changes, the base
    alone = linkable.select("node", "fp", F.col("node").alias("part"), sizes(F.col("node"), F.col("m")).alias("at"))
    stored = materialise(wide_keys(alone, False), "stored")
    first = F.struct((1 - F.col("at.m") / F.col("at.n")).alias("own"), F.col("node").alias("b"), F.col("word").alias("y"), F.col("at").alias("at2"))
    lead = stored.groupBy("key").agg(F.min(first).alias("l"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "l.*")
    stars = merged(stored, lead, "key").where(near("word", "y") & (F.col("node") != F.col("b")) & _may_reach("at", "at2", similarity))
    stars = stars.select(F.col("node").alias("a"), "b", "at.n", "at.m", F.col("at2.n").alias("n2"), F.col("at2.m").alias("m2")).distinct()
    led = materialise(_similar(materialise(stars, "stars"), text_of, shingle, similarity), "led")
    first = F.struct((1 - F.col("m2") / F.col("n2")).alias("own"), F.col("b").alias("hub"), "both", "n2", "m2")
    hubs = led.groupBy(F.col("a").alias("node")).agg(F.min(first).alias("h"))
    # one step more: with the lead of the lead, so that more nodes of a group are compared with the same
    above = hubs.select(F.col("node").alias("b"), F.col("h.hub").alias("top"), F.col("h.n2").alias("n3"), F.col("h.m2").alias("m3"))
    more = merged(led.select("a", "b", "n", "m"), above, "b").where("top <> a").select("a", F.col("top").alias("b"), "n", "m", F.col("n3").alias("n2"), F.col("m3").alias("m2"))
    more = materialise(merged(more.distinct(), led.select("a", "b"), ["a", "b"], "left_anti"), "stars")
    led = materialise(led.unionByName(_similar(more, text_of, shingle, similarity)), "led")
    part = components(led.where("linked").select("a", "b")).select("node", F.col("component").alias("part"))
    classes = materialise(merged(nodes.select("node"), part, "node", "left").select("node", F.coalesce("part", "node").alias("part")), "merged")

    # a node whose shared shingles its lead has all, and that is no smaller, is no more similar to any other than its lead
    done = led.where("linked AND m <= both AND n >= n2 AND struct(1 - m2 / n2, b) < struct(1 - m / n, a)").select(F.col("a").alias("node")).distinct()
    # what each has in common with a lead, the first of its leads by the same order, bounds what two of that lead have in common
    hubs = led.groupBy(F.col("a").alias("node")).agg(F.min(first).alias("h"))
    at = sizes(F.coalesce("h.hub", "node"), F.coalesce("h.both", "m")).alias("at")
    found = merged(merged(merged(linkable, done, "node", "left_anti"), hubs, "node", "left"), classes, "node")
    parted = materialise(found.select("node", "fp", "part", at), "parted")
    mine = wide_keys(parted, False).select("key", F.col("node").alias("a"), F.struct("word", "at").alias("x"), "part")
    theirs = wide_keys(parted, True).select("key", F.col("node").alias("b"), F.struct("word", "at").alias("y"), F.col("part").alias("part2"))
    met = meet_across(mine, theirs).where(near("x.word", "y.word") & _may_reach("x.at", "y.at", similarity))
    far = F.bit_count(F.col("x.word").bitwiseXOR(F.col("y.word"))).alias("d")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("part")).otherwise(F.col("part2")).alias("part"), far)
    pairs = materialise(met.distinct(), "pairs")
    nth = F.row_number().over(Window.partitionBy("b", "part").orderBy("d", "a"))
    ranked = materialise(pairs.withColumn("nth", nth), "ranked")
    for some in (F.col("nth") <= 4, F.col("nth") > 4):
        now = classes.select(F.col("node"), F.col("part").alias("p"))
        left = merged(ranked.where(some), now.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
        left = merged(left, now.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        left = materialise(left.where("pa <> pb").select("a", "b", "pa", "pb"), "left")
        found = components(_similar(left, text_of, shingle, similarity).where("linked").select("pa", "pb"))
        found = found.select(F.col("node").alias("part"), "component")
        classes = materialise(merged(classes, found, "part", "left").select("node", F.coalesce("component", "part").alias("part")), "merged")
    return merged(member, classes, "node").select("row", F.col("part").alias("group"))


def _may_reach(x: str, y: str, similarity: float) -> Column:
    """Whether two sets (SIZES) can be that similar: they have in common at most what each shares with any other set; and if they
    were compared with one hub, what both have of it and what both share beyond it."""
    of = lambda name: (F.col(f"{x}.{name}"), F.col(f"{y}.{name}"))
    (n, n2), (m, m2), (hub, hub2), (o, o2) = map(of, ("n", "m", "hub", "o"))
    common = F.when(hub == hub2, F.least(o, o2) + F.least(m - o, m2 - o2)).otherwise(F.least(m, m2))
    return (1 + similarity) * common >= similarity * (n + n2) - 1e-6


def _keep_least(rows: DataFrame, row: str, groups: DataFrame, id_col: str) -> DataFrame:
    """One row of each group (row, group): that with the least id (null last), then the least number."""
    named = rows.select(F.col(row).alias("row"), F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col(row).alias("n")).alias("rank"))
    judged = materialise(merged(named, groups, "row"), "judged")
    several = judged.groupBy("group").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = merged(judged, several.select("group", "best"), "group").where("rank.n <> best.n").select(F.col("row").alias(row))
    gone = materialise(gone, "gone")
    few = gone.count() <= BROADCAST_ROWS  # then the texts stay where they are
    return (rows.join(F.broadcast(gone), row, "left_anti") if few else merged(rows, gone, row, "left_anti")).drop(row)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that with the least id, rows without an id last.  Rows
    are told apart by a number of their own, so those that share an id are judged each."""
    rows, row = numbered(docs, "documents")
    found = near_duplicates(rows, row, text_col).select(F.col(row).alias("row"), F.col("component_id").alias("group"))
    return _keep_least(rows, row, found, id_col)


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each of ``similar_groups``, chosen as by ``keep_one``; an empty table stays empty."""
    rows, row = numbered(docs, "documents")
    return _keep_least(rows, row, similar_groups(rows, row, text_col, shingle, similarity), id_col)
