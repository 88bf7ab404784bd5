"""Word tables of Arrow text batches, without a Python loop over words.

``WordTable`` holds, for a run of whole documents, the byte range and a 64-bit hash of every word.  All
words are found with a byte class table, so multi-byte characters count as their UTF-8 bytes: the two word
patterns used here put every byte from 0x80 on inside words, so this equals matching on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once (a longer document is handled whole): bounds the memory of the numpy arrays.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
SPACE_SEPARATED = np.ones(256, dtype=bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = True
ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D


def powers(n: int, base: int = _STEP) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(1 << 12)


class WordTable:
    """Words of consecutive documents.

    ``data``: their (lower-cased) bytes; ``start``/``end``: each word's byte range; ``doc``: its document's
    place in the run; ``first``: index of each document's first word, with the total at the end; ``hash``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool):
        global _POWERS
        self.data = LOWER[data] if lower else data
        n, docs = len(data), len(offsets) - 1
        inside = classes[self.data]
        starts, ends = inside.copy(), inside.copy()
        if n:
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            filled = offsets[:-1] < offsets[1:]
            a, b = offsets[:-1][filled], offsets[1:][filled] - 1
            starts[a] = inside[a]
            ends[b] = inside[b]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))
        sizes = self.end - self.start
        self.hash = np.zeros(len(sizes), dtype=np.uint64)
        if len(sizes):
            longest, total = int(sizes.max()), int(sizes.sum())
            table = _POWERS if longest <= len(_POWERS) else powers(longest)
            begins, letters = np.cumsum(sizes) - sizes, self.data[inside]
            cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, total, CHUNK_BYTES)), len(sizes))).tolist()
            for i, j in zip(cuts[:-1], cuts[1:]):  # in blocks, as a very long document comes in one piece
                lo, hi = int(begins[i]), int(begins[j]) if j < len(sizes) else total
                own = begins[i:j] - lo
                parts = _BYTE[letters[lo:hi]] * table[np.arange(hi - lo) - np.repeat(own, sizes[i:j])]
                self.hash[i:j] = mix(np.add.reduceat(parts, own) + sizes[i:j].astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, a: int, b: int, joint: bytes = b" ") -> bytes:
        """Words a to b (exclusive), joined."""
        raw = self.data.tobytes() if b - a > 4096 else None
        if raw is not None:
            return joint.join([raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())])
        return joint.join([self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())])

    def grams(self, n: int, values: np.ndarray | None = None) -> np.ndarray:
        """Hash of the n words from each word on (positions whose n words leave the document have no meaning)."""
        words = self.hash if values is None else values
        m = len(words) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(m, dtype=np.uint64)
        for i in range(n):
            out *= np.uint64(_STEP)
            out += words[i : i + m]
        return mix(out)

    def whole(self, n: int) -> np.ndarray:
        """For each gram of n words: does it lie inside one document?"""
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=bool)
        return self.doc[:m] == self.doc[n - 1 :]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes, each of one document at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def tables(column: pa.Array, classes: np.ndarray, lower: bool, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, WordTable]]:
    """(first document, end, WordTable) over a text column."""
    data, offsets = raw(column)
    for a, b in chunks(offsets, most):
        lo, hi = int(offsets[a]), int(offsets[b])
        yield a, b, WordTable(data[lo:hi], offsets[a : b + 1] - lo, classes, lower)


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
