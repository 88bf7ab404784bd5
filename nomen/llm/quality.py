"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

A document is its UTF-8 bytes.  Learned filters of ``WIDTH`` bytes slide over every position; overlapping
chunks of ``CHUNK`` bytes that cover the whole text are max-pooled, each chunk's pooled features pass a small
hidden layer, and the mean and the maximum of all chunks' hidden values give one probability.

Training takes a bounded sample of labelled rows (``max_docs`` documents in the order of a hash of their id, with all their
chunks; a step draws DRAW of those of a long document).  It is dealt into SHARDS shards; in each of ROUNDS rounds a task per shard goes on from the common network by
Adam steps, and the driver averages the SHARDS results, whose size is fixed.  Scoring reads whole texts.

Only the text enters a score.  Null and empty texts are scored as one chunk of padding; repeated rows give equal scores;
of rows that share a labelled id, the one with the least text is learned from; equal ids in ``labels`` take the least
label; ties in the order of the sample are settled by the id; an empty table gives no rows; without any usable label every
score is 0.5; other columns are ignored, whatever their names.  A very long text is pooled piece by piece, with its bytes and
one row of features per chunk in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm import _words
from nomen.llm._shared import materialise

WIDTH, EMBED, FILTERS, HIDDEN = 6, 8, 24, 12
CHUNK, OVERLAP = 512, 64
MAX_DOCS, BATCH = 5000, 48
DRAW = 8  #: chunks that a step takes of a document with more, drawn anew in each step
SHARDS, ROUNDS, STEPS = 4, 5, 120  #: steps of a shard in a round
THRESHOLD = 0.3


@dataclass
class ByteConvNet:
    embed: np.ndarray  #: 256 x EMBED
    kernel: np.ndarray  #: WIDTH x EMBED x FILTERS
    bias: np.ndarray  #: FILTERS
    hidden: np.ndarray  #: FILTERS + 2 x HIDDEN; the last two inputs are the chunk's size
    hidden_bias: np.ndarray
    out: np.ndarray  #: 2 * HIDDEN
    out_bias: np.ndarray  #: 1

    @classmethod
    def fresh(cls, seed: int = 0) -> ByteConvNet:
        r = np.random.default_rng(seed)
        f = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        convolution = f(0.5, 256, EMBED), f((WIDTH * EMBED) ** -0.5, WIDTH, EMBED, FILTERS), f(0, FILTERS)
        return cls(*convolution, f(FILTERS**-0.5, FILTERS + 2, HIDDEN), f(0, HIDDEN) + np.float32(0.1), f(0.1, 2 * HIDDEN), f(0, 1))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def tables(self) -> list[np.ndarray]:
        """For each pair of neighbouring filter places, what each two bytes add to every filter."""
        one = [self.embed @ self.kernel[w] for w in range(WIDTH)]
        return [(one[w][:, None, :] + one[w + 1][None, :, :]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)]

    def pooled(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Max over the filter places of each byte range; every range has WIDTH bytes at least."""
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        n = len(data) - WIDTH + 1
        acts = tables[0].take(pair[:n], axis=0)
        for j in range(1, len(tables)):
            acts += tables[j].take(pair[2 * j : 2 * j + n], axis=0)
        acts = np.concatenate([acts, acts[-1:]])  # so that the last range may end at the end
        at = np.stack([begins, ends - WIDTH + 1], axis=1).ravel()
        return np.concatenate([np.maximum(np.maximum.reduceat(acts, at, axis=0)[::2] + self.bias, 0), sizes(ends - begins)], axis=1)

    def head(self, pooled: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
        """Probabilities of documents from their chunks' pooled features; doc_first: each one's first chunk."""
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        counts = np.diff(np.append(doc_first, len(h)))
        both = np.concatenate([np.add.reduceat(h, doc_first, axis=0) / counts[:, None], np.maximum.reduceat(h, doc_first, axis=0)], axis=1)
        return 1 / (1 + np.exp(-np.clip((both @ self.out + self.out_bias).astype(np.float64), -30, 30)))


def sizes(n: np.ndarray) -> np.ndarray:
    """What the head learns of a chunk's size: a short text fires few filters without being poor."""
    return np.stack([n / CHUNK, np.log2(n) / 9], axis=1).astype(np.float32)


def chunk_ranges(size: int) -> list[tuple[int, int]]:
    """Overlapping byte ranges that cover a text of so many (padded) bytes."""
    step = CHUNK - OVERLAP
    last = max(0, -(-(size - CHUNK) // step))
    return [(i * step, min(size, i * step + CHUNK)) for i in range(last + 1)]


def _padded(text: bytes) -> bytes:
    return text if len(text) >= WIDTH else text + bytes(WIDTH - len(text))


def score_texts(net: ByteConvNet, tables: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts, in groups of about 256 KB of text; a longer text is pooled piece by piece."""
    out = np.zeros(len(texts))
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size >= 1 << 18 or i == len(texts) - 1:
            parts = [_padded(texts[k]) for k in group]
            begins, ends, first, at = [], [], [], 0
            for p in parts:
                first.append(len(begins))
                for a, b in chunk_ranges(len(p)):
                    begins.append(at + a)
                    ends.append(at + b)
                at += len(p)
            data = np.frombuffer(b"".join(parts), np.uint8)
            b, e = np.array(begins), np.array(ends)
            pooled = []
            for lo in range(0, len(b), 512):
                s, t2 = b[lo], e[min(lo + 512, len(b)) - 1]
                pooled.append(net.pooled(data[s:t2], b[lo : lo + 512] - s, e[lo : lo + 512] - s, tables))
            out[group] = net.head(np.concatenate(pooled), np.array(first))
            group, size = [], 0
    return out


@dataclass
class Training:
    """A network with the moments of Adam; ``step``: steps taken (of a shard)."""

    net: ByteConvNet
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int = 0

    @classmethod
    def fresh(cls, seed: int = 0) -> Training:
        net = ByteConvNet.fresh(seed)
        return cls(net, [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()])

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.net.parts(), *self.first, *self.second)]).astype(np.float32)

    @classmethod
    def of_vector(cls, values: np.ndarray, step: int) -> Training:
        out, at = cls.fresh(), 0
        for p in (*out.net.parts(), *out.first, *out.second):
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        out.step = step
        return out

    def run(self, samples: list[tuple[list[bytes], int]], steps: int, total: int, rng: np.random.Generator) -> None:
        """Adam on the log loss; the rate falls to 0 over ``total`` steps.  Gradients pass through the places of the maxima only."""
        by_label = [[i for i, (_, y) in enumerate(samples) if y == v] for v in (0, 1)]
        if not all(by_label):
            return
        share = len(by_label[1]) / len(samples)
        # half of each label, weighted back in part to the shares of the sample: rare labels keep a say
        weight = np.sqrt(np.where(np.arange(BATCH) < BATCH // 2, 1 - share, share) * 2)
        for _ in range(steps):
            self.step += 1
            pick = np.concatenate([rng.choice(by_label[v], BATCH // 2) for v in (0, 1)])
            batch = [samples[i] for i in pick]
            batch = [(cs if len(cs) <= DRAW else [cs[k] for k in rng.choice(len(cs), DRAW, replace=False)], y) for cs, y in batch]
            gradients = _gradients(self.net, batch, weight)
            rate = 0.01 * min(1.0, 2 * (1 - (self.step - 1) / total))
            for part, grad, m, v in zip(self.net.parts(), gradients, self.first, self.second):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                part -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)


def _gradients(net: ByteConvNet, batch: list[tuple[list[bytes], int]], weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted mean log loss, in the order of ``parts``."""
    n_docs = len(batch)
    chunks = [c.ljust(CHUNK, b"\0") if len(c) < WIDTH else c for cs, _ in batch for c in cs]
    length = np.array([len(c) for c in chunks])
    ends = np.cumsum(length)
    begins = ends - length
    first = np.cumsum([0] + [len(cs) for cs, _ in batch])[:-1]
    data = np.frombuffer(b"".join(chunks), np.uint8)
    y = np.array([label for _, label in batch])
    tables = net.tables()
    where = []  # chunk x filter: the place of each maximum, in pieces of some chunks
    for lo in range(0, len(chunks), 256):
        hi = min(lo + 256, len(chunks))
        piece = data[begins[lo] : ends[hi - 1]]
        pair = piece[:-1].astype(np.int32) * 256 + piece[1:]
        n = len(piece) - WIDTH + 1
        acts = tables[0].take(pair[:n], axis=0)
        for j in range(1, len(tables)):
            acts += tables[j].take(pair[2 * j : 2 * j + n], axis=0)
        where += [b + acts[b - begins[lo] : e - begins[lo] - WIDTH + 1].argmax(axis=0) for b, e in zip(begins[lo:hi], ends[lo:hi])]
    where = np.stack(where)
    byte = [data[where + w] for w in range(WIDTH)]
    raw = net.bias + sum(np.einsum("cfe,ef->cf", net.embed[byte[w]], net.kernel[w]) for w in range(WIDTH))
    pooled = np.concatenate([np.maximum(raw, 0), sizes(length)], axis=1)
    pre = pooled @ net.hidden + net.hidden_bias
    h = np.maximum(pre, 0)
    counts = np.diff(np.append(first, len(h)))
    doc = np.repeat(np.arange(n_docs), counts)
    top = np.maximum.reduceat(h, first, axis=0)
    both = np.concatenate([np.add.reduceat(h, first, axis=0) / counts[:, None], top], axis=1)
    p = 1 / (1 + np.exp(-np.clip(both @ net.out + net.out_bias, -30, 30)))
    g = ((p - y) * weight / n_docs).astype(np.float32)
    d_both = g[:, None] * net.out
    d_h = d_both[doc, :HIDDEN] / counts[doc][:, None]
    d_h = (d_h + np.where(h == top[doc], d_both[doc, HIDDEN:], 0)) * (pre > 0)
    d_pool = (d_h @ net.hidden[:FILTERS].T) * (raw > 0)
    d_kernel, d_embed = np.zeros_like(net.kernel), np.zeros_like(net.embed)
    for w in range(WIDTH):
        d_kernel[w] = np.einsum("cfe,cf->ef", net.embed[byte[w]], d_pool)
        for e in range(EMBED):
            d_embed[:, e] += np.bincount(byte[w].ravel(), (d_pool * net.kernel[w][e]).ravel(), 256)
    return [d_embed, d_kernel, d_pool.sum(axis=0), pooled.T @ d_h, d_h.sum(axis=0), both.T @ g, np.array([g.sum()], np.float32)]


def fit(samples: list[tuple[list[bytes], int]], steps: int, seed: int = 0) -> ByteConvNet | None:
    """A network trained in one place.  samples: (chunks, label)."""
    if len({y for _, y in samples}) < 2:
        return None
    state = Training.fresh(seed)
    state.run(samples, steps, steps, np.random.default_rng(seed))
    return state.net


def held_out(id_col: str) -> F.Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = MAX_DOCS,
    rounds: int = ROUNDS,
    steps: int = STEPS,
) -> ByteConvNet | None:
    """Fit on ``max_docs`` labelled documents at most."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    some = usable.where(~held_out("id")).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = materialise(texts.withColumn("shard", F.pmod(F.hash("id"), F.lit(SHARDS))), "sample")
    if sample.agg(F.count_distinct("y")).first()[0] < 2:
        return None

    def go_on(state: Training, number: int):
        start = sample.sparkSession.sparkContext.broadcast(state.vector())

        def run(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["id"].to_pylist(), table["y"].to_pylist(), table["text"].to_pylist()))
            data = [(_padded(text.encode()), y) for _, y, text in rows]
            own = Training.of_vector(start.value, state_step)
            shard = table["shard"][0].as_py()
            own.run([([t[a:b] for a, b in chunk_ranges(len(t))], y) for t, y in data], steps, rounds * steps, np.random.default_rng([number, shard]))
            return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(rows)], pa.int64()), "values": pa.array([own.vector().tobytes()], pa.binary())})

        state_step = state.step
        # by range, so that each shard is a task of its own however small the sample is
        return sample.repartitionByRange(SHARDS, "shard").groupBy("shard").applyInArrow(run, "shard int, n long, values binary").collect()

    state = Training.fresh()
    for number in range(rounds):
        found = sorted(go_on(state, number), key=lambda r: r["shard"])
        total = sum(r["n"] for r in found)
        mean = sum(np.frombuffer(bytes(r["values"]), np.float32) * np.float64(r["n"] / total) for r in found)
        state = Training.of_vector(mean.astype(np.float32), state.step + steps)
    return state.net


def score(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in batches:
            scores = _scores(net, tables, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double"
    found = docs.select(id_col, text_col).mapInArrow(run, schema)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scores(net: ByteConvNet | None, tables: list[np.ndarray], column: pa.Array) -> np.ndarray:
    if net is None:
        return np.full(len(column), 0.5)
    data, offsets = _words.raw(column)
    out = []
    for a, b in _words.chunks(offsets, 1 << 20):
        out.append(score_texts(net, tables, [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]))
    return np.concatenate(out) if out else np.zeros(0)


def keep(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in batches:
            yield batch.filter(pa.array(_scores(net, tables, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
