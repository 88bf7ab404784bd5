"""Words of names: vocabularies, counts, filters and encoded sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomen import model
from nomen.functions.columns import split_name
from nomen.operators.kg import dense_ids


def name_words(names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the words of each name exploded as (pos, word)."""
    return names.select("*", F.posexplode(split_name(name)).alias("pos", "word"))


def count_words(words: DataFrame, word: str = "word") -> DataFrame:
    return words.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(words: DataFrame, min_count: int = 3, word: str = "word") -> DataFrame:
    """(word, idx, n): three special words first, then words of ``min_count`` or more by count and word."""
    kept = count_words(words, word).where(F.col("n") >= min_count).withColumn("less", -F.col("n"))
    ranked = dense_ids(kept, ["less", "word"], start=3, out="idx")
    special = words.sparkSession.createDataFrame([(w, i, None) for i, w in enumerate((model.START, model.END, model.UNKNOWN))], "word string, idx long, n long")
    return special.unionByName(ranked.select("word", "idx", "n"))


def word_counts_by_type(words: DataFrame, type_: str = "type", word: str = "word", least: int = 2) -> DataFrame:
    """(type, word, n) of words of ``least`` letters or more."""
    return words.where(F.length(word) >= least).groupBy(F.col(type_).alias("type"), F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def filter_words(freqs: DataFrame, corpus: DataFrame, always: int = 700) -> DataFrame:
    """``freqs(word, n)`` over ``always``, or longer than two letters and in the reference corpus (word)."""
    marked = freqs.join(corpus.select("word").distinct().withColumn("_in", F.lit(True)), "word", "left")
    return marked.where((F.col("n") > always) | ((F.length("word") > 2) & F.coalesce("_in", F.lit(False)))).select("word", "n")


def ordered_word_ids(freqs: DataFrame) -> DataFrame:
    """(word, n, id) by falling frequency, then word."""
    return dense_ids(freqs.withColumn("less", -F.col("n")), ["less", "word"], out="id").select("word", "n", "id")


def encode_words(items: DataFrame, vocab: DataFrame, id_col: str, words: str = "words") -> DataFrame:
    """(id, ids, length): start, word numbers (2 for unknown words), end."""
    each = items.select(id_col, F.posexplode(words).alias("pos", "word")).join(vocab.select("word", "idx"), "word", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idx", F.lit(2)).alias("idx")))), lambda x: x["idx"])
    coded = each.groupBy(id_col).agg(ids.alias("_ids"))
    out = items.select(id_col).join(coded, id_col, "left")
    full = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("_ids", F.array().cast("array<bigint>")), F.array(F.lit(1).cast("long")))
    return out.select(id_col, full.alias("ids"), F.size(full).alias("length"))


def padded_batches(encoded: DataFrame, id_col: str, size: int = 200) -> DataFrame:
    """``encoded`` with batch and place: batches of ``size`` rows in id order, each by falling length, padded with 0."""
    numbered = dense_ids(encoded, [id_col], out="_n").withColumn("batch", F.floor(F.col("_n") / size))
    w = Window.partitionBy("batch")
    longest = F.max("length").over(w)
    place = F.row_number().over(w.orderBy(F.desc("length"), id_col)) - 1
    pad = F.array_repeat(F.lit(0).cast("long"), longest - F.col("length"))
    return numbered.select(id_col, "batch", place.alias("place"), F.concat("ids", pad).alias("ids"), "length")


def decode_words(coded: DataFrame, vocab: DataFrame, id_col: str, ids: str = "ids") -> DataFrame:
    """(id, name): words up to the end mark, without start and unknown, joined by underscores."""
    end = F.array_position(ids, F.lit(1).cast("long"))
    upto = F.when(end > 0, F.slice(ids, F.lit(1), (end - 1).cast("int"))).otherwise(F.col(ids))
    each = coded.select(id_col, F.posexplode_outer(F.filter(upto, lambda i: ~i.isin(0, 2))).alias("pos", "idx"))
    named = each.join(vocab.select("idx", "word"), "idx", "left")
    return named.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), "_").alias("name"))


def pattern_overlap(origins: DataFrame, patterns: DataFrame, salts: int = 16) -> DataFrame:
    """(origin_id, pattern_id, common): patterns(pattern_id, item) that share an item with origins(origin_id, item), with what
    they share.  Rows of an item are dealt over ``salts`` tasks by their pattern, as some items are nearly everywhere."""
    mine = origins.select("origin_id", "item").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    theirs = patterns.select("pattern_id", "item").distinct().withColumn("salt", F.pmod(F.xxhash64("pattern_id"), F.lit(salts)).cast("int"))
    return theirs.join(mine, ["item", "salt"]).groupBy("origin_id", "pattern_id").agg(F.array_sort(F.collect_list("item")).alias("common"))
