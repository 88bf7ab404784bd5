"""Masked pseudo-likelihood: a window network predicts every word from both sides.

Words are counted over all documents.  The network's vocabulary is the ``FREQUENT`` most frequent words, and hash classes
for the others.  The network sees ``REACH`` words on each side of a hidden place: a table per place gives a hidden layer
(tanh), and a two-level softmax (groups of words, then the words of a group) the probability of the hidden word.  A word
outside the vocabulary also pays for its share of its class: its count over the class's, for the ``exact_words`` most
frequent of them; the rest of a class is shared evenly by the types that are left.  A document's score is the sum of the
log-probabilities of all its words, each given its true neighbours.

Training covers every word of the corpus once.  Documents are dealt by a hash of id and text into ``rounds`` rounds and, in a
round, into as many shards as the counted words ask for (``SHARD_WORDS``).  A task per shard trains its own copy in numpy
(Adagrad), and the copies are averaged, weighted by their words, in a tree of fan-in ``FAN``; only the averaged network, of
fixed size, reaches the driver.  So the scores don't depend on how the input is partitioned.

Null texts count as empty; a document without words has log_prob 0 and a null mean; an empty table gives no rows;
repeated rows are trained and scored each; other columns are ignored.  Ties of counts are settled by the word's hash.  A
text is handled as a whole in its task, in arrays of about 40 bytes for each of its bytes.
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

FREQUENT, OTHERS, GROUP = 1984, 64, 64
EXACT_WORDS = 1 << 20  #: words with a count of their own: 16 bytes each in every task
VOCABULARY = FREQUENT + OTHERS
PAD = VOCABULARY  #: beyond a document's ends
REACH, HIDDEN = 3, 16
PLACES = 2 * REACH
BATCH, RATE, ROUNDS, FAN, BLOCKS = 8192, 0.15, 2, 64, 16
SHARD_WORDS = 4_000_000

GROUPS = VOCABULARY // GROUP
_SHAPES = {
    "places": (PLACES, VOCABULARY + 1, HIDDEN),
    "bias": (HIDDEN,),
    "group": (HIDDEN, GROUPS),
    "group_bias": (GROUPS,),
    "word": (GROUPS, GROUP, HIDDEN),
    "word_bias": (GROUPS, GROUP),
}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


class WindowNetwork:
    """All parameters in one vector, with a view for each part."""

    def __init__(self, values: np.ndarray):
        self.values, at = values, 0
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, values[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, unigrams: np.ndarray, seed: int = 0) -> WindowNetwork:
        """Small random weights; biases that give the corpus's word frequencies."""
        net = cls((np.random.default_rng(seed).standard_normal(SIZE) * 0.1).astype(np.float32))
        share = (unigrams + 1) / (unigrams + 1).sum()
        by_group = share.reshape(-1, GROUP)
        net.bias[:] = 0
        net.group_bias[:] = np.log(by_group.sum(axis=1))
        net.word_bias[:] = np.log(by_group / by_group.sum(axis=1, keepdims=True))
        return net

    def forward(self, around: np.ndarray, target: np.ndarray, gradient: WindowNetwork | None = None) -> np.ndarray:
        """Log-probabilities of the targets; with ``gradient``, adds the gradients of their mean loss to it."""
        n = len(target)
        pre = self.places[0].take(around[0], axis=0)
        for p in range(1, PLACES):
            pre += self.places[p].take(around[p], axis=0)
        h = np.tanh(pre + self.bias)
        group = target // GROUP
        scores = h @ self.group + self.group_bias
        scores -= scores.max(axis=1, keepdims=True)
        chances = np.exp(scores)
        total = chances.sum(axis=1, keepdims=True)
        rows = np.arange(n)
        log = scores[rows, group] - np.log(total[:, 0])
        order = np.argsort(group.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
        edge = np.searchsorted(group[order], np.arange(GROUPS + 1))
        if gradient is not None:
            d = chances / total
            d[rows, group] -= 1
            d /= n
            d_h = d @ self.group.T
            gradient.group += h.T @ d
            gradient.group_bias += d.sum(axis=0)
        for g in range(GROUPS):
            at = order[edge[g] : edge[g + 1]]
            if not len(at):
                continue
            mine, own = h[at], target[at] % GROUP
            s = mine @ self.word[g].T + self.word_bias[g]
            s -= s.max(axis=1, keepdims=True)
            e = np.exp(s)
            t = e.sum(axis=1, keepdims=True)
            log[at] += s[np.arange(len(at)), own] - np.log(t[:, 0])
            if gradient is not None:
                d = e / t
                d[np.arange(len(at)), own] -= 1
                d /= n
                d_h[at] += d @ self.word[g]
                gradient.word[g] += d.T @ mine
                gradient.word_bias[g] += d.sum(axis=0)
        if gradient is not None:
            d_pre = d_h * (1 - h * h)
            gradient.bias += d_pre.sum(axis=0)
            for p in range(PLACES):
                order = np.argsort(around[p].astype(np.uint16), kind="stable")
                ids = around[p][order]
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                gradient.places[p][ids[first]] += np.add.reduceat(d_pre[order], first, axis=0)
        return log


def neighbours(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """PLACES x words: the neighbours of every word inside its document; ``first``: documents' first words and the end."""
    n, out = len(ids), np.full((PLACES, len(ids)), PAD, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for p, shift in enumerate([s for s in range(-REACH, REACH + 1) if s]):
        a, b = max(0, -shift), min(n, n - shift)
        if a < b:
            same = doc[a:b] == doc[a + shift : b + shift]
            out[p, a:b] = np.where(same, ids[a + shift : b + shift], PAD)
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word: 64-bit hash of the lower-cased word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [t.hash for _, _, t in _words.tables(batch.column(0), _words.ALPHANUMERIC, True)]
            if parts:
                words, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What scoring knows of words: sorted hashes, each one's number in the network, and the log of its share of that number."""

    words: np.ndarray
    numbers: np.ndarray
    shares: np.ndarray
    rest: np.ndarray  #: by hash class: the log share of each word that is not listed

    @classmethod
    def of(cls, top: list[tuple[int, int]], counts: np.ndarray, types: np.ndarray) -> Lexicon:
        """``top``: (word, count), most frequent first; ``counts``, ``types``: of all words beyond FREQUENT, by hash class."""
        words = np.array([w for w, _ in top], np.int64).view(np.uint64)
        n = np.array([c for _, c in top], float)
        rank = np.arange(len(words))
        classes = (words % np.uint64(OTHERS)).astype(np.int64)
        numbers = np.where(rank < FREQUENT, rank, FREQUENT + classes)
        later = rank >= FREQUENT
        shares = np.where(later, np.log(n / np.maximum(counts[classes], 1)), 0.0)
        left = np.maximum(counts - np.bincount(classes[later], n[later], OTHERS), 0)
        left_types = np.maximum(types - np.bincount(classes[later], minlength=OTHERS), 1)
        rest = np.log(np.maximum(left, 1) / left_types / np.maximum(counts, 1))
        order = np.argsort(words)
        return cls(words[order], numbers[order].astype(np.uint16), shares[order].astype(np.float32), rest)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and log shares of words."""
        classes = (hashes % np.uint64(OTHERS)).astype(np.int64)
        if not len(self.words):
            return FREQUENT + classes, self.rest[classes]
        distinct, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        known, at = (self.words[at] == distinct)[back], at[back]
        return np.where(known, self.numbers[at], FREQUENT + classes), np.where(known, self.shares[at], self.rest[classes])


def encoded(docs: DataFrame, lexicon: Lexicon, shards: int, rounds: int, id_col: str, text_col: str) -> DataFrame:
    """(id, deal, round, shard, ids: 16-bit word numbers, extra: sum of the log shares)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, b, t in _words.tables(batch.column(1), _words.ALPHANUMERIC, True):
                ids, share = own.look_up(t.hash)
                ids, total = ids.astype(np.uint16), np.append(0, np.cumsum(share, dtype=np.float64))
                data = [ids[x:y].tobytes() for x, y in zip(t.first[:-1].tolist(), t.first[1:].tolist())]
                extra = total[t.first[1:]] - total[t.first[:-1]]
                columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(data, pa.binary()), pa.array(extra)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "deal", "ids", "extra"])

    dealt = docs.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("deal"))
    found = dealt.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, deal long, ids binary, extra double")
    in_turn = F.shiftright("deal", 8)
    return found.withColumn("round", F.pmod("deal", F.lit(rounds))).withColumn("shard", F.pmod(in_turn, F.lit(shards)).cast("int"))


def _streams(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole documents with ``least`` words or more (the last may have fewer): ids and documents' first words."""
    held: list[np.ndarray] = []
    size = 0
    rows = column.to_pylist()
    for i, data in enumerate(rows):
        held.append(np.frombuffer(data, np.uint16).astype(np.int64))
        size += len(held[-1])
        if size >= least or i == len(rows) - 1:
            yield np.concatenate(held), np.cumsum([0, *map(len, held)])
            held, size = [], 0


def _train_round(tokens: DataFrame, net: WindowNetwork, shards: int) -> WindowNetwork:
    start = tokens.sparkSession.sparkContext.broadcast(net.values)
    edges = np.linspace(0, SIZE, BLOCKS + 1).astype(int)

    def train(table: pa.Table) -> pa.Table:
        own, seen = WindowNetwork(start.value.copy()), 0
        past = np.full(SIZE, 1e-4, np.float32)
        gradient = WindowNetwork(np.zeros(SIZE, np.float32))
        table = table.sort_by([("deal", "ascending"), ("ids", "ascending")])
        for ids, first in _streams(table["ids"], BATCH):
            around = neighbours(ids, first)
            for a in range(0, len(ids), BATCH):
                gradient.values[:] = 0
                own.forward(around[:, a : a + BATCH], ids[a : a + BATCH], gradient)
                past += gradient.values * gradient.values
                own.values -= RATE * gradient.values / np.sqrt(past)
            seen += len(ids)
        blocks = [own.values[a:b].astype(np.float64).tobytes() for a, b in zip(edges[:-1], edges[1:])] if seen else []
        n, part = len(blocks), table["shard"][0].as_py()
        columns = [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([float(seen)] * n, pa.float64()), pa.array(blocks, pa.binary())]
        return pa.table(columns, names=["block", "part", "weight", "values"])

    def average(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["weight"].to_pylist(), table["values"].to_pylist()))
        weight = sum(r[1] for r in rows)
        mean = sum(np.frombuffer(r[2]) * (r[1] / weight) for r in rows)
        return pa.table({"block": table["block"].slice(0, 1), "part": pa.array([rows[0][0] // FAN], pa.int32()), "weight": pa.array([weight]), "values": pa.array([mean.tobytes()], pa.binary())})

    schema = "block int, part int, weight double, values binary"
    copies, parts = tokens.select("shard", "deal", "ids").groupBy("shard").applyInArrow(train, schema), shards
    while True:
        copies = copies.groupBy("block", F.floor(F.col("part") / FAN).alias("of")).applyInArrow(average, schema)
        if parts <= FAN:
            break
        parts = -(-parts // FAN)
    rows = sorted(copies.collect(), key=lambda r: r["block"])
    return WindowNetwork(np.concatenate([np.frombuffer(bytes(r["values"])) for r in rows]).astype(np.float32)) if rows else net


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    exact_words: int = EXACT_WORDS,
) -> DataFrame:
    """(id, n_words, log_prob, mean_log_prob) for every document; each is trained on in one of ``rounds`` rounds."""
    if rounds < 1:
        raise ValueError("there must be a round")
    counts = materialise(word_counts(docs, text_col), "words")
    listed = counts.orderBy(F.desc("n"), "word").limit(max(FREQUENT, exact_words)).toArrow()
    top = sorted(zip(listed["word"].to_pylist(), listed["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    unigrams, types = np.zeros(VOCABULARY), np.zeros(OTHERS)
    # a hash class is the unsigned hash's low bits, so the signed value's too
    for r in counts.groupBy(F.col("word").bitwiseAND(OTHERS - 1).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        unigrams[FREQUENT + r["c"]], types[r["c"]] = r["n"], r["types"]
    total = unigrams.sum()
    for rank, (word, n) in enumerate(top[:FREQUENT]):
        unigrams[rank] = n
        unigrams[FREQUENT + word % OTHERS] -= n
        types[word % OTHERS] -= 1
    shards = max(1, -(-int(total) // (rounds * SHARD_WORDS)))
    tokens = materialise(encoded(docs, Lexicon.of(top, unigrams[FREQUENT:], types), shards, rounds, id_col, text_col), "ids")
    net = WindowNetwork.fresh(unigrams)
    for r in range(rounds):
        net = _train_round(tokens.where(F.col("round") == r), net, shards)
    trained = docs.sparkSession.sparkContext.broadcast(net.values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WindowNetwork(trained.value)
        for batch in batches:
            sums, sizes = [], []
            for ids, first in _streams(batch.column(1), BATCH):
                around = neighbours(ids, first)
                log = [own.forward(around[:, a : a + BATCH], ids[a : a + BATCH]).astype(np.float64) for a in range(0, len(ids), BATCH)]
                total = np.append(0, np.cumsum(np.concatenate(log))) if log else np.zeros(1)
                sums.append(total[first[1:]] - total[first[:-1]])
                sizes.append(np.diff(first))
            n = np.concatenate([*sizes, np.zeros(0, int)])
            s = np.concatenate([*sums, np.zeros(0)]) + np.asarray(batch.column(2))
            mean = pa.array(s / np.maximum(n, 1), mask=n == 0)
            columns = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(s), mean]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "log_prob", "mean_log_prob"])

    kind = docs.schema[id_col].dataType.simpleString()
    return tokens.select("id", "ids", "extra").mapInArrow(score, f"`{id_col}` {kind}, n_words long, log_prob double, mean_log_prob double")
