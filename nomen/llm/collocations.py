"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

A text is cut into pieces at marks and line ends, and pieces into words.  ``f`` of a phrase is the number of its contiguous
occurrences within pieces; everything is counted per language.

1. Words are counted per group of documents and then in all.  Words below ``least`` end every phrase.
2. Leading words.  Each group counts its pairs of frequent words, and sends each pair once to the pair's bucket;
   buckets give the frequent pairs.  Frequent words and pairs are known to all tasks as bitmaps of fixed size, where a false
   positive costs time and no result.
3. Suffixes.  From each word on, the suffix goes as far as its pairs are frequent, up to the longest phrase; equal ones of a
   group are one with a weight.  Suffixes of three words or more are routed by their first three.  A bucket sorts
   pointers to its suffixes by multikey three-way quicksort, word by word down to the last: the weight of an equal
   partition is the count of the words so far, and a partition below ``least`` is abandoned.  Leading words that
   hold a large part of a group's suffixes are hot: theirs are dealt by the fourth word too, and their own counts are summed
   up over the buckets.
4. Scores of all cuts by joins on the counts, in exact decimal arithmetic.

Null texts count as empty and a null language as ``und``; repeated rows count each; an empty table gives no rows;
other columns are ignored.  Words are told apart by 64-bit hashes of language and word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen.llm import _words
from nomen.llm._shared import materialise

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
GROUP_BYTES = 8 << 20
BITMAP_BITS = 1 << 26
HOT_SHARE = 64  #: leading words with this part of a group's suffixes are looked at as hot ones

_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_CLASSES = ~_MARKS
_CLASSES[[0x20, 0x09]] = False
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Group:
    """Words of a run of documents: ``symbol`` (a hash of language and word), and whether a word's next one is in its piece."""

    def __init__(self, table: _words.WordTable, langs: list[str]):
        seeds = {x: xxhash.xxh64_intdigest(x.encode("utf-8")) for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], np.uint64)
        self.table = table
        self.symbol = _words.mix(table.hash ^ seed[table.doc]) if len(table) else np.zeros(0, np.uint64)
        self.symbol[self.symbol == 0] = 1  # zero fills up short suffixes
        marks = np.zeros(len(table.data) + 1, np.int32)
        np.cumsum(_MARKS[table.data], out=marks[1:])
        self.joint = np.zeros(len(table), bool)
        if len(table) > 1:
            self.joint[:-1] = (table.doc[1:] == table.doc[:-1]) & (marks[table.start[1:]] == marks[table.end[:-1]])


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Group]]:
    langs = [UNKNOWN if x is None else x for x in batch.column(1).to_pylist()]
    for a, b, t in _words.tables(batch.column(0), _CLASSES, True, GROUP_BYTES):
        yield langs[a:b], Group(t, langs[a:b])


def _collapsed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct hashes, in their order, and their counts."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(order)))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _words.mix(a * _STEPS[0] + b * _STEPS[1])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n) of all words of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, g in _groups(batch):
                at, counts = _collapsed(g.symbol)
                t, raw = g.table, g.table.data.tobytes()
                words = [raw[s:e] for s, e in zip(t.start[at].tolist(), t.end[at].tolist())]
                names = pa.array([langs[d] for d in t.doc[at].tolist()], pa.string())
                columns = [names, pa.array(words, pa.binary()).cast(pa.string()), pa.array(_words.to_signed(g.symbol[at])), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])

    found = docs.mapInArrow(run, "lang string, word string, h long, n long")
    return found.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The cells of the hashes (one column ``h``) by their upper bits: never more than ``bits`` of them reach the driver."""
    size = bits.bit_length() - 1
    cell = F.shiftrightunsigned("h", 64 - size)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def has(map_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a ``bitmap``."""
    cell = h >> np.uint64(64 - (len(map_) * 64).bit_length() + 1)
    return ((map_[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1)).astype(bool)


def _blobs(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row per bucket with its part of each column."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    spans = list(zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()))
    out = [pa.array(bucket[order[edge]].astype(np.int32))]
    for column in columns:
        sorted_ = column[order]
        out.append(pa.array([sorted_[a:b].tobytes() for a, b in spans], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *names])


def _read(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])


def _buckets(docs: DataFrame) -> int:
    """A power of two, in proportion to the input's partitions."""
    return 1 << max(3, (2 * docs.rdd.getNumPartitions() - 1).bit_length())


def frequent_pairs(docs: DataFrame, words: np.ndarray, least: int, buckets: int) -> DataFrame:
    """(h1, h2, n) of the neighbouring words that occur ``least`` times together."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, g in _groups(batch):
                known = has(shared.value, g.symbol)
                good = g.joint.copy()
                good[:-1] &= known[:-1] & known[1:]
                at = np.flatnonzero(good)
                if len(at):
                    pairs = _pair_hash(g.symbol[at], g.symbol[at + 1])
                    one, counts = _collapsed(pairs)
                    yield _blobs((pairs[one] >> shift).astype(np.int64), [g.symbol[at[one]], g.symbol[at[one] + 1], counts.astype(np.uint32)], ["a", "b", "n"])

    def merge(table: pa.Table) -> pa.Table:
        a, b, n = _read(table, "a", np.uint64), _read(table, "b", np.uint64), _read(table, "n", np.uint32)
        order = np.argsort(_pair_hash(a, b), kind="stable")
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        total = np.add.reduceat(n.astype(np.int64), first)
        keep = total >= least
        return pa.table({"h1": _words.to_signed(a[first[keep]]), "h2": _words.to_signed(b[first[keep]]), "n": total[keep]})

    return docs.mapInArrow(run, "bucket int, a binary, b binary, n binary").groupBy("bucket").applyInArrow(merge, "h1 long, h2 long, n long")


def suffixes(group: Group, words: np.ndarray, pairs: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct suffixes of three words or more, as a column for each word (0: none), and their weights."""
    known = has(words, group.symbol)
    good = group.joint.copy()
    if len(good):
        good[:-1] &= known[:-1] & known[1:]
        at = np.flatnonzero(good)
        good[at] = has(pairs, _pair_hash(group.symbol[at], group.symbol[at + 1]))
    n = len(good)
    start = np.flatnonzero(good[: n - 1] & good[1:]) if n > 1 else np.zeros(0, np.int64)
    columns, alive = [group.symbol[start], group.symbol[start + 1], group.symbol[start + 2]], np.ones(len(start), bool)
    whole = columns[0] * _STEPS[0] + columns[1] * _STEPS[1] + columns[2] * _STEPS[2]
    for d in range(3, longest):
        alive = alive & good[np.minimum(start + d - 1, n - 1)]
        column = np.where(alive, group.symbol[np.minimum(start + d, n - 1)], np.uint64(0))
        columns.append(column)
        whole = _words.mix(whole) * _STEPS[3] + column
    one, counts = _collapsed(_words.mix(whole))
    return [c[one] for c in columns], counts


def _leading(columns: list[np.ndarray]) -> np.ndarray:
    return _words.mix(columns[0] * _STEPS[0] + columns[1] * _STEPS[1] + columns[2] * _STEPS[2])


def equal_partitions(columns: list[np.ndarray], weight: np.ndarray, least: int, depth: int = 0) -> list[tuple[int, int, int]]:
    """(pointer, words, count) of every prefix that has a weight of ``least`` or more, by multikey three-way quicksort from
    the word ``depth`` on, up to which all suffixes agree.

    A partition is given up as soon as its whole weight is below ``least``.
    """
    found: list[tuple[int, int, int]] = []
    stack = [(np.arange(len(weight)), depth)]
    while stack:
        at, depth = stack.pop()
        values = columns[depth][at]
        pivot = values[len(at) >> 1]
        for side, deeper in ((values < pivot, False), (values > pivot, False), (values == pivot, True)):
            part = at[side]
            total = int(weight[part].sum()) if len(part) else 0
            if total < least:
                continue
            if not deeper:
                stack.append((part, depth))
            elif pivot:
                found.append((int(part[0]), depth + 1, total))
                if depth + 1 < len(columns):
                    stack.append((part, depth + 1))
    return found


def long_phrases(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, least: int, longest: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(key, n): phrases of three words or more; those of ``hot`` leading words (hashes) come in several parts."""
    spark = docs.sparkSession
    shared_words, shared_pairs = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(pairs)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    names = [f"w{i}" for i in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, g in _groups(batch):
                columns, counts = suffixes(g, shared_words.value, shared_pairs.value, longest)
                if not len(counts):
                    continue
                lead = _leading(columns)
                if len(hot) and longest > 3:
                    lead = np.where(np.isin(lead, hot), _words.mix(lead + columns[3]), lead)
                yield _blobs((lead >> shift).astype(np.int64), [*columns, counts.astype(np.uint32)], [*names, "n"])

    def sort(table: pa.Table) -> pa.Table:
        columns, weight = [_read(table, c, np.uint64) for c in names], _read(table, "n", np.uint32).astype(np.int64)
        parts: list[tuple[int, int, int]] = []
        lead = _leading(columns)
        dealt = np.isin(lead, hot)
        for rows in (np.flatnonzero(~dealt), *(np.flatnonzero(lead == x) for x in np.unique(lead[dealt]))):
            depth = 0
            if len(rows) and dealt[rows[0]]:  # of hot leading words only a part is here
                parts.append((int(rows[0]), 3, int(weight[rows].sum())))
                depth = 3
            if len(rows) and depth < longest:
                some = equal_partitions([c[rows] for c in columns], weight[rows], least, depth)
                parts += [(int(rows[i]), d, n) for i, d, n in some if d >= 3]
        keys = [[int(columns[j][i].view(np.int64)) for j in range(d)] for i, d, _ in parts]
        return pa.table({"key": pa.array(keys, pa.list_(pa.int64())), "n": pa.array([n for *_, n in parts], pa.int64())})

    schema = "bucket int, " + ", ".join(f"{c} binary" for c in names) + ", n binary"
    return docs.mapInArrow(run, schema).groupBy("bucket").applyInArrow(sort, "key array<long>, n long")


def hot_leads(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, longest: int, share: int = HOT_SHARE) -> np.ndarray:
    """Hashes of leading words that hold one of ``2 * share`` parts of all distinct suffixes of groups: at most that many."""
    spark = docs.sparkSession
    shared_words, shared_pairs = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, g in _groups(batch):
                columns, counts = suffixes(g, shared_words.value, shared_pairs.value, longest)
                lead = _leading(columns)
                one, sizes = _collapsed(lead)
                large = (sizes * share > len(counts)) & (sizes > 1000)
                rows = pa.array(_words.to_signed(np.append(lead[one[large]], np.uint64(0))))
                yield pa.RecordBatch.from_arrays([rows, pa.array(np.append(sizes[large], len(counts)).astype(np.int64))], names=["lead", "n"])

    total = docs.mapInArrow(run, "lead long, n long").groupBy("lead").agg(F.sum("n").alias("n"))
    total = materialise(total, "leads")
    whole = total.where("lead = 0").agg(F.sum("n")).first()[0] or 0
    rows = total.where((F.col("lead") != 0) & (F.col("n") * 2 * share > whole)).select("lead").toArrow()
    return rows["lead"].to_numpy().view(np.uint64)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """words (lang, word, h, n), all of them; and phrases (key: hashes of words, n) of up to ``longest`` words that occur
    ``least`` times at least."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    docs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words = materialise(word_counts(docs), "words")
    frequent = words.where(F.col("n") >= least)
    buckets = _buckets(docs)
    word_map = bitmap(frequent.select("h"))
    pairs = materialise(frequent_pairs(docs, word_map, least, buckets), "pairs")
    found = frequent.select(F.array("h").alias("key"), "n").unionByName(pairs.select(F.array("h1", "h2").alias("key"), "n"))
    if longest > 2:
        pair_map = _pair_bitmap(pairs)
        hot = hot_leads(docs, word_map, pair_map, longest) if longest > 3 else np.zeros(0, np.uint64)
        more = long_phrases(docs, word_map, pair_map, least, longest, buckets, hot)
        more = more.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found = found.unionByName(more)
    return words, materialise(found, "phrases")


def _pair_bitmap(pairs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_words.to_signed(_pair_hash(a, b)))], names=["h"])

    return bitmap(pairs.select("h1", "h2").mapInArrow(run, "h long"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the ``top`` phrases by score, then count, then text.

    The score of a cut is floor(1000 * a * n / (l * r)); a phrase has that of its lowest cut, the first of equals.  Phrases
    inside a longer one with the same count are left out.
    """
    words, phrases = phrase_counts(docs, least, longest, text_col, lang_col)
    size = F.size("key")
    whole = words.groupBy("lang").agg(F.sum("n").alias("all"))
    own = phrases.where(size >= 2).withColumnRenamed("n", "a")
    inner = F.flatten(
        F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(F.lit(2), F.least(size - i + 1, size - 1)), lambda m: F.slice("key", i, m)))
    )
    # every shorter phrase that lies in a frequent one: sequence counts down where there is none, so these are filtered
    inside = own.where(size >= 3).select("a", F.explode(F.filter(inner, lambda x: (F.size(x) >= 2) & (F.size(x) < size))).alias("part"))
    covered = inside.groupBy(F.col("part").alias("key")).agg(F.max("a").alias("longer"))
    kept = own.join(covered, "key", "left").where("longer IS NULL OR longer < a").select("key", "a")
    first = words.select("lang", F.col("h").alias("first"))
    placed = kept.withColumn("first", F.col("key")[0]).join(first, "first").join(whole, "lang").select("lang", "all", "key", "a")
    cuts = placed.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("key", F.lit(1), F.col("k"))).withColumn("right", F.slice("key", F.col("k") + 1, size))
    side = lambda key, n: phrases.select(F.col("key").alias(key), F.col("n").alias(n))
    met = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    big = lambda x, y: f"CAST(CAST({x} AS DECIMAL(19, 0)) * CAST({y} AS DECIMAL(19, 0)) AS DECIMAL(38, 0))"
    scored = met.withColumn("score", F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {big('a', '`all`')} DIV {big('l', 'r')}"))
    lowest = scored.groupBy("lang", "all", "key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    flat = lowest.select("lang", "key", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("all").alias("n"), F.col("c.score").alias("score"))
    near = flat.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place")
    near = materialise(near, "ranked")
    spelt = near.select("key", F.posexplode("key").alias("i", "h")).join(words.select("h", "word"), "h")
    texts = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(texts, "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
k AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM w),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM k WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
cut AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * cut.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:cut.k], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[cut.k+1:], ' ') JOIN n ON n.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT lang, a, w, m, unnest(range(1, m)) AS i FROM c WHERE m >= 3),
part2 AS (SELECT lang, a, w, m, i, unnest(range(2, m)) AS j FROM part),
inside AS (SELECT lang, array_to_string(w[i:i+j-1], ' ') AS phrase, max(a) AS longer FROM part2 WHERE i + j - 1 <= m GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
