"""Packing documents into fixed-length token sequences: concatenate and cut.

First pass: every document is tokenised once, and its ids are written to the shared folder together with the
number of ids before it in its partition.  The partitions' totals (one row each) are summed up to global
offsets.  Second pass: each document knows its place in the one long sequence, so that it is cut at the
multiples of the sequence length without any shuffle; each piece is a boundary record.

Every id lies in exactly one piece and only the last sequence can be short.  Null text counts as empty and
packs as its end id alone; repeated rows are packed each; an empty table gives no pieces; other columns are
ignored.  A text is encoded as a whole in its task, so a very long one takes a few times its size in memory; its pieces
are cut like any other's.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen.llm._shared import give_back, materialise

LENGTH = 2048
END_ID = 1


class Encoder:
    """Token ids as ``tokenizers`` gives them with the settings of its JSON file (special strings included).

    Byte-level vocabularies cut a text before a space and around a line end that stands between two other characters, and
    before a point or comma after a letter: no token reaches over such a cut.  So each distinct word is encoded once
    per process and remembered (``most_words`` bounds the memory: the store is emptied when it is full, which costs time
    only).  Other vocabularies encode text by text.  Ids are little-endian numbers of ``type``.
    """

    _LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
    _CUT = re.compile(r" (?<=\S )(?=\S)")
    _SPACE = re.compile(r"\s")
    _MARKS = (".", ",")
    _AT_ONCE = 200  # words in a text that is encoded

    def __init__(self, path: str, most_words: int = 3 << 19):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        pre = plan.get("pre_tokenizer") or {}
        added = "".join(t["content"] for t in plan.get("added_tokens", ()))
        self.by_words = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and plan.get("normalizer") is None
        self.by_words &= not self._SPACE.search(added) and not any(m in added for m in self._MARKS)
        self.most_words = most_words
        self.known: dict[str, bytes] = {}  # words after a space
        self.starts: dict[str, bytes] = {}  # beginnings of lines
        self.leads = np.zeros(size, bool)  # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.leads[i] = token.startswith("\u0120")
        if self.by_words:
            self.line_end, *self.marks = self._pieces(["\n", *self._MARKS])

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that stand for themselves."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(found.ids, self.type).tobytes()
        edge = (np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(pieces) + 1)) * self.type.itemsize).tolist()
        return [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]

    @staticmethod
    def _sound(word: str) -> bool:
        """May a text be cut at a space on either side of this word?"""
        return word != "" and not word[0].isspace() and not word[-1].isspace()

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words with a space before them."""
        odd = {w for w in words if self._SPACE.search(w)}
        marked = {w for w in words if len(w) > 1 and w[-1] in self._MARKS and w[-2].isalpha()} - odd
        bare = words - odd - marked
        bare.update(w for m in marked if (w := m[:-1]) not in self.known)
        bare = list(bare)
        for at in range(0, len(bare), self._AT_ONCE):  # as one text: each word begins with the only token that has a space
            part = bare[at : at + self._AT_ONCE]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, self.type)
            edge = (np.append(np.flatnonzero(self.leads[ids]), len(ids)) * self.type.itemsize).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(edge[:-1], edge[1:])], strict=True))
        for w in marked:
            self.known[w] = self.known[w[:-1]] + self.marks[self._MARKS.index(w[-1])]
        if odd:
            self.known.update(zip(odd, self._pieces([" " + w for w in odd])))

    def _lines(self, text: str) -> list[str]:
        lines = text.split("\n")
        return lines if all(map(self._sound, lines)) else self._LINE.split(text)

    def _line(self, line: str) -> bytes:
        """A line with spaces in a row or other white space beside one."""
        head, *words = self._CUT.split(line)
        self._learn({w for w in words if self._sound(w) and w not in self.known})
        pieces = iter(self._pieces([head, *(" " + w for w in words if not self._sound(w))]))
        return next(pieces) + b"".join([self.known[w] if self._sound(w) else next(pieces) for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) + len(self.starts) > self.most_words:
            self.known.clear()
            self.starts.clear()
        known, starts, sound = self.known, self.starts, self._sound
        lines = [[line.partition(" ") for line in self._lines(t)] for t in texts]
        words = [[rest.split(" ") if space else [] for _, space, rest in p] for p in lines]
        heads = {line[0] for p in lines for line in p}.difference(starts)
        if heads := [w for w in heads if sound(w)]:
            starts.update(zip(heads, self._pieces(heads)))
        if new := {w for w in set().union(*(line for p in words for line in p)).difference(known) if sound(w)}:
            self._learn(new)
        get, out = known.__getitem__, []
        for p, q in zip(lines, words):
            found = []
            for line, rest in zip(p, q):
                try:
                    found.append(starts[line[0]] + b"".join(map(get, rest)))
                except KeyError:  # unsound words are not remembered
                    found.append(self._line("".join(line)))
            out.append(self.line_end.join(found))
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per process, so that tasks of the same worker share what it remembers; ``_shared.make_room`` drops it."""
    return Encoder(path)


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, part, before, n_ids, ids): ids as little-endian unsigned 16-bit numbers, or 32-bit (then n_ids * 4 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        wide = np.dtype("<u4") if end_id > 65535 else encode.type
        end = np.array([end_id], wide).tobytes()
        try:
            for batch in batches:
                texts = batch.column(1)
                for a in range(0, len(batch), 256):
                    ids = encode.encode([t or "" for t in texts.slice(a, 256).to_pylist()])
                    if wide != encode.type:
                        ids = [np.frombuffer(x, encode.type).astype(wide).tobytes() for x in ids]
                    ids = [x + end for x in ids]
                    sizes = np.array([len(x) // wide.itemsize for x in ids], np.int64)
                    starts = before + np.cumsum(sizes) - sizes
                    before += int(sizes.sum())
                    parts = pa.array(np.full(len(ids), part, np.int32))
                    columns = [batch.column(0).slice(a, 256), parts, pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "before", "n_ids", "ids"])
        finally:
            batch = texts = ids = columns = None
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, part int, before long, n_ids long, ids binary")


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids: little-endian 32-bit)."""
    tokens = materialise(tokenised(docs, path, id_col, text_col, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # one row per partition: the only unpartitioned window, and small enough to broadcast
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("before")).alias("place"), "n_ids", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in (whole.slice(a, 512) for whole in batches for a in range(0, len(whole), 512)):
                rows: list[list] = [[] for _ in range(8)]
                for doc, place, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(place + start, length)
                        size = min(length - offset, n - start)
                        piece = ids[start : start + size].tobytes()
                        for column, value in zip(rows, (doc, start, size, zlib.crc32(piece), n, sequence, offset, piece)):
                            column.append(value)
                        start += size
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
                numbers = [pa.array(c, pa.int64()) for c in rows[1:7]]
                columns = [pa.array(rows[0], batch.schema.field(0).type), *numbers, pa.array(rows[7], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            batch = rows = columns = numbers = None
            give_back()

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long"
    return placed.mapInArrow(cut, schema + ", doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids): whole sequences, padded to ``length`` except where they end at a power of two.

    A group holds ``length`` ids at most, so grouping by sequence gathers nothing large.
    """
    n = F.sum("length")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"])), "")
    out = pieces.groupBy("sequence_id").agg(n.alias("n_ids"), F.unhex(ids).alias("ids"))
    gap = F.when((F.col("n_ids").bitwiseAND(F.col("n_ids") - 1)) == 0, F.lit(0)).otherwise(F.lit(length) - F.col("n_ids"))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), gap.cast("int")))
    return out.select("sequence_id", "n_ids", F.concat("ids", pad).alias("ids"))
