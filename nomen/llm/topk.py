"""Exact top-k search over term vectors by MaxScore.

Candidates are dealt into shards; a shard keeps, for each term (dimension), its postings and the least and the
largest weight.  A query walks its terms from the largest score bound down.  As long as the terms that are left
could lift an unseen document over the k-th best score, they are essential and their postings are traversed;
after that only documents still competitive are probed for the other terms, and each is given up as soon as
its bound falls below the k-th best.  Bounds count negative weights, and ties are kept, so that the result is
exact.  The shards' best are merged by rank.

The index of a shard is built once and stored.  Queries come in blocks, and each block meets each shard in one task, so
that memory is that of one block and one shard; an index is only sent once for each ``block_rows`` queries.  The first
wave takes a few shards, and the k-th best scores found there are the bars that the second wave starts with.

Every query row is ranked for itself, also where query ids repeat (``query_row`` tells them apart).  Rows whose vector is null or holds null, NaN or infinite components take no part, nor do null ids;
missing trailing components count as 0; repeated ids are separate candidates, and none of them answers a query of
the same id.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen.llm._shared import materialise, numbered

SHARD_ROWS, BLOCK_ROWS = 65536, 32768
FIRST_SHARDS = 8  #: one shard of so many is searched in the first wave


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v: array<long>): floor(scale * x) of each usable row."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return usable.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of equal width; missing trailing components are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten(), np.int64)
    return out


class Shard:
    """Postings of a shard's documents, by term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        self.n, self.terms = vectors.shape
        self.lists: list[tuple[slice | np.ndarray, np.ndarray]] = []
        for j in range(self.terms):
            at = np.flatnonzero(vectors[:, j])
            self.lists.append((slice(None), vectors[:, j].copy()) if len(at) > 0.8 * self.n else (at, vectors[at, j]))
        self.columns = np.asfortranarray(vectors)
        self.least = np.minimum(vectors.min(axis=0, initial=0), 0)
        self.most = np.maximum(vectors.max(axis=0, initial=0), 0)

    def search(self, query_id: int, query: np.ndarray, k: int, bar: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best (all of those tied with the k-th are considered; smaller ids win).

        ``bar``: a score that k documents elsewhere reach; what stays below it may be left out.
        """
        q = np.zeros(self.terms, np.int64)
        m = min(self.terms, len(query))
        q[:m] = query[:m]
        upper = np.maximum(q * self.least, q * self.most)
        lower = np.minimum(q * self.least, q * self.most)
        terms = np.flatnonzero(q)
        terms = terms[np.argsort(-upper[terms], kind="stable")]
        rest_up = np.append(np.cumsum(upper[terms][::-1])[::-1], 0)
        rest_low = np.append(np.cumsum(lower[terms][::-1])[::-1], 0)
        score = np.zeros(self.n, np.int64)
        other = self.ids != query_id
        i = 0
        # essential terms: traverse postings while the rest could still lift an unseen document over the bar
        while i < len(terms) and (bar is None or rest_up[i] >= bar):
            at, weights = self.lists[terms[i]]
            score[at] += q[terms[i]] * weights
            i += 1
            if i % 4 == 0 or i == len(terms):
                bar = self._bar(score[other], k, rest_low[i], bar)
        alive = np.flatnonzero(other & (score + rest_up[i] >= bar) if bar is not None else other)
        partial = score[alive]
        # the other terms: probe what is still competitive
        while i < len(terms):
            partial = partial + q[terms[i]] * self.columns[alive, terms[i]]
            i += 1
            if i % 4 == 0 or i == len(terms):
                bar = self._bar(partial, k, rest_low[i], bar)
                keep = partial + rest_up[i] >= bar if bar is not None else np.ones(len(partial), bool)
                alive, partial = alive[keep], partial[keep]
        best = np.lexsort((self.ids[alive], -partial))[:k]
        return self.ids[alive[best]], partial[best]

    @staticmethod
    def _bar(scores: np.ndarray, k: int, rest: int, bar: int | None) -> int | None:
        """What the k-th best reaches at least."""
        if len(scores) < k:
            return bar
        new = int(np.partition(scores, len(scores) - k)[len(scores) - k]) + int(rest)
        return new if bar is None else max(bar, new)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_row, query_id, rank, id, score): the k largest inner products of each query row, ties to smaller ids.

    Both inputs are (id, v: array<long>).  ``shard_rows`` and ``block_rows`` bound a task, not the result.
    """
    n = candidates.count()
    shards = max(1, -(-n // shard_rows))
    asked, row = numbered(queries.select("id", "v"), "queries")
    blocks = max(1, -(-asked.count() // block_rows))

    def build(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["v"])
        data = [np.asarray(table["id"], np.int64).tobytes(), vectors.tobytes()]
        width = pa.array([vectors.shape[1]], pa.int32())
        return pa.table({"shard": table["shard"].slice(0, 1), "width": width, "ids": pa.array(data[:1], pa.binary()), "vectors": pa.array(data[1:], pa.binary())})

    # rows are dealt by their number, so that a repeated id fills no shard
    dealt = candidates.select("id", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    index = materialise(dealt.groupBy("shard").applyInArrow(build, "shard int, width int, ids binary, vectors binary"), "index")
    asked = asked.select(F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int").alias("block"), F.col(row).alias("query_row"), F.col("id").alias("query_id"), "v")

    def meet(key: tuple, asking: pa.Table, stored: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(asking) and len(stored):
            ids = np.frombuffer(stored["ids"][0].as_buffer(), np.int64)
            shard = Shard(ids, np.frombuffer(stored["vectors"][0].as_buffer(), np.int64).reshape(len(ids), stored["width"][0].as_py()))
            rows = (asking[c].to_pylist() for c in ("query_row", "query_id", "bar"))
            for query_row, query_id, bar, v in zip(*rows, _matrix(asking["v"])):
                found, scores = shard.search(query_id, v, k, bar)
                out.append((np.full(len(found), query_row), np.full(len(found), query_id), found, scores))
        names = ["query_row", "query_id", "id", "score"]
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})

    def wave(first: bool, asking: DataFrame) -> DataFrame:
        """The best of each query in each shard of the first wave, or of the second."""
        of = lambda shard: (shard % FIRST_SHARDS == 0) == first
        to = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), of))
        sent = asking.select(to.alias("shard"), "block", "query_row", "query_id", "v", "bar")
        own = index.where(of(F.col("shard"))).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        both = sent.groupBy("shard", "block").cogroup(own.groupBy("shard", "block"))
        return both.applyInArrow(meet, "query_row long, query_id long, id long, score long")

    by_rank = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    best = wave(True, asked.withColumn("bar", F.lit(None).cast("long")))
    if shards > 1:
        first = best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).drop("rank")
        first = materialise(first, "first")
        bars = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
        best = first.unionByName(wave(False, asked.join(bars, "query_row", "left").select("block", "query_row", "query_id", "v", "bar")))
    return best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
