"""Byte-level BPE encoding and decoding over documents of any length: overlapping chunks are pre-tokenised in parallel,
stitched where their pre-token boundaries meet again, and the pieces between the stitches are encoded.

1. A document of one chunk (``CHUNK`` code points) is encoded where it is read.  A longer one is cut into chunks that share
   ``OVERLAP`` code points with the next one, and the chunks are dealt out.
2. Each chunk is pre-tokenised from its own start.  The first pre-token may begin in the middle of one, but after a few
   characters both chunks of a border find the same boundaries again: the least boundary that both have in their overlap
   is where they are stitched.  Only boundaries count that hold whatever stood before them (a letter before something
   that is no letter, a digit before what is no digit, any visible character before white space), so that the text can be
   cut there without a change of any match on either side.
3. Chunks without a common boundary (a run of one kind of characters longer than the overlap) stay in one piece with
   the chunk before, however many there are.
4. Pieces are encoded each on its own.  Decoding concatenates the bytes of the ids.

Null texts count as empty and have no ids; repeated rows and repeated or null ids are documents of their own; an empty table
gives no rows; other columns are ignored.  Ids are those of ``tiktoken`` for every text, also for runs of white space
that are too long for its pattern engine.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen.llm._shared import materialise

CHUNK = 1 << 16
OVERLAP = 1 << 12
_LOOKAHEAD = 4  #: code points that a match may look at beyond its end
_LONG_RUN = 1 << 14  #: white space in a row that is encoded apart
_SOUND = regex.compile(r"\p{L}\P{L}|\p{N}\P{N}|\S\s", regex.DOTALL)
_PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)
_BLANK = regex.compile(r"\s{%d,}" % _LONG_RUN)


class Codec:
    """Encoding and decoding by the ranks of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values(), default=0)
        self.type = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.bytes = [b""] * (top + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.digits = [f"{i}," for i in range(top + 1)]

    def encode(self, text: str) -> list[int]:
        if len(text) < _LONG_RUN:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for run in _BLANK.finditer(text):
            # such a run begins a match; what follows it takes or ends with its last character
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.encoding._core_bpe.encode_single_piece(text[run.start() : end].encode("utf-8"))
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decimals(self, ids: list[int]) -> bytes:
        """The ids in decimal, each with a comma after it."""
        return "".join(map(self.digits.__getitem__, ids)).encode()


@functools.cache
def codec(path: str) -> Codec:
    """One codec per process."""
    return Codec(path)


def boundaries(text: str, lo: int, hi: int, last: int) -> tuple[list[int], list[int]]:
    """Sound pre-token boundaries of a chunk up to ``lo``, and those from ``hi`` up to ``last``."""
    head, tail = [], []
    for match in _PRE_TOKEN.finditer(text):
        p = match.end()
        if (p <= lo or p >= hi) and p <= last and _SOUND.match(text, p - 1):
            if p <= lo:
                head.append(p)
            if p >= hi:
                tail.append(p)
    return head, tail


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, id, k, start, text, last, head, tail): the pre-tokenised chunks of documents, with a number for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    if overlap >= chunk:
        raise ValueError("a chunk must be longer than its overlap")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py()
                n = max(1, -(-len(text) // chunk))
                for a in range(0, n, 64):  # a few megabytes at once
                    ks = range(a, min(a + 64, n))
                    texts = [text[k * chunk : (k + 1) * chunk + overlap] for k in ks]
                    rows, ids = batch.column(0).take(pa.array([i] * len(ks))), batch.column(1).take(pa.array([i] * len(ks)))
                    columns = [rows, ids, pa.array(list(ks), pa.int64()), pa.array([k * chunk for k in ks], pa.int64()), pa.array(texts, pa.string()), pa.array([k == n - 1 for k in ks])]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "k", "start", "text", "last"])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, text, k in zip(*(batch.column(c).to_pylist() for c in ("start", "text", "k"))):
                head, tail = boundaries(text, overlap if k else -1, chunk, len(text) - _LOOKAHEAD)
                heads.append([start + p for p in head])
                tails.append([start + p for p in tail])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, lists), pa.array(tails, lists)], names=[*batch.schema.names, "head", "tail"])

    schema = f"row long, id {kind}, k long, start long, text string, last boolean"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = numbered.mapInArrow(cut, schema).repartition("row", "k")
    return dealt.mapInArrow(pre_tokenise, schema + ", head array<long>, tail array<long>")


def stitched(found: DataFrame) -> DataFrame:
    """(row, id, piece, k, text): the chunks' own parts.  Those between two stitches have the same ``piece`` and are to be
    read in the order of ``k``."""
    after = found.select("row", (F.col("k") + 1).alias("k"), "tail")
    # the first stitch of a border; null where its chunks have no boundary in common
    border = found.select("row", "k", "head").join(after, ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("head", "tail")).alias("stitch"))
    per = Window.partitionBy("row").orderBy("k")  # a few numbers for each chunk
    begins = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("stitch"))
    joined = found.drop("head", "tail").join(border, ["row", "k"], "left").withColumn("begins", begins)
    placed = joined.select("row", "k", "start", "last", "begins").select(
        "row",
        "k",
        F.last(F.when(F.col("begins").isNotNull(), F.col("k")), ignorenulls=True).over(per).alias("piece"),
        F.coalesce("begins", "start").alias("lo"),
        F.lead(F.coalesce("begins", "start")).over(per).alias("hi"),
    )
    own = F.substring("text", (F.col("lo") - F.col("start") + 1).cast("int"), F.coalesce(F.col("hi") - F.col("lo"), F.length("text").cast("long")).cast("int"))
    return found.select("row", "id", "k", "start", "text").join(placed, ["row", "k"]).select("row", "id", "piece", "k", own.alias("text"))


def encode_pieces(parts: DataFrame, path: str) -> DataFrame:
    """(row, id, piece, n_tokens, ids) of ``stitched`` parts; ``ids``: little-endian, 16 bits where the vocabulary allows it."""
    kind = parts.schema["id"].dataType.simpleString()
    ordered = parts.repartition("row", "piece").sortWithinPartitions("row", "piece", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, texts = codec(path), None, []

        def done(type_: pa.DataType) -> pa.RecordBatch:
            ids = own.encode("".join(texts))
            columns = [pa.array([now[0]], pa.int64()), pa.array([now[1]], type_), pa.array([now[2]], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, own.type).tobytes()], pa.binary())], names=["row", "id", "piece", "n_tokens", "ids"])

        for batch in batches:
            type_ = batch.schema.field("id").type
            for row, id_, piece, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "piece", "text"))):
                if now is not None and (row, piece) != (now[0], now[2]):
                    yield done(type_)
                    texts = []
                now = (row, id_, piece)
                texts.append(text)
        if now is not None:
            yield done(type_)

    return ordered.mapInArrow(run, f"row long, id {kind}, piece long, n_tokens long, ids binary")


def _whole(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, n_tokens, ids) of documents of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for a in range(0, len(batch), 256):
                ids = [own.encode(t or "") for t in batch.column(1).slice(a, 256).to_pylist()]
                columns = [batch.column(0).slice(a, 256), pa.array([len(x) for x in ids], pa.int64()), pa.array([np.array(x, own.type).tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def _both(docs: DataFrame, id_col: str, text_col: str, path: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.length(text_col), F.lit(0))
    long_ = materialise(chunks(docs.where(size > chunk), id_col, text_col, chunk, overlap), "chunks")
    return _whole(docs.where(size <= chunk), id_col, text_col, path), encode_pieces(stitched(long_), path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, row, piece, n_tokens, ids): the ids of each document, in one piece with null ``row`` or, for a long one, in
    pieces with a ``row`` of its own, whose ids follow one another by ``piece``."""
    whole, pieces = _both(docs, id_col, text_col, path, chunk, overlap)
    short = whole.select("id", F.lit(None).cast("long").alias("row"), F.lit(0).cast("long").alias("piece"), "n_tokens", "ids")
    return short.unionByName(pieces).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (of ``encode``) with ``data``, the bytes of its ids; a character can be cut between two pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data = [own.decode(np.frombuffer(raw, own.type).tolist()) for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, schema + ", data binary")


def _digests(tokens: DataFrame, path: str, id_col: str, rows: bool) -> DataFrame:
    """One row per document; with ``rows`` the pieces of a document follow one another in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        doc = 0  # number of the document: each row is one, or each run of equal ``row``
        now = None

        def result(done: list[list], type_: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], type_), pa.array([d[1] for d in done], pa.int64()), *(pa.array([d[i].hexdigest() for d in done], pa.string()) for i in (2, 3))]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            type_, done = batch.schema.field("id").type, []
            keys = batch.column("row").to_pylist() if rows else range(doc, doc + len(batch))
            doc += len(batch)
            for key, id_, raw in zip(keys, batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if now is None or now[4] != key:
                    if now is not None:
                        done.append(now)
                    now = [id_, 0, hashlib.sha256(), hashlib.sha256(), key]
                ids = np.frombuffer(raw, own.type).tolist()
                if ids:
                    text = own.decimals(ids)
                    now[2].update(b"," + text[:-1] if now[1] else text[:-1])
                    now[3].update(own.decode(ids))
                    now[1] += len(ids)
            yield result(done, type_)
        if now is not None:
            yield result([now], type_)

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of each document's ids (in decimal, with commas) and of the bytes that
    they decode to.  The pieces of a long document pass through one running digest and are never gathered."""
    whole, pieces = _both(docs, id_col, text_col, path, chunk, overlap)
    ordered = pieces.repartition("row").sortWithinPartitions("row", "piece")
    return _digests(whole, path, id_col, False).unionByName(_digests(ordered, path, id_col, True))
