"""Line-based inputs and outputs: mapping files, reports, logs and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomen.operators._lineage import cut
from nomen.operators.lines import number_lines


def load_lines(spark: SparkSession, path: str, file_glob: str = "*") -> DataFrame:
    """(app: file, line: number from 0, value) with each file's order kept; a file is read in as many splits as its size asks
    for.  A line end at a file's end begins no line, and an empty file has none."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).option("lineSep", "\n")
    place = [F.col("_metadata.file_path").alias("app"), F.col("_metadata.file_block_start").alias("start")]
    rows = reader.text(path).select(*place, F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "\r$", "").alias("value"))
    # written: the counts of the splits belong to these row numbers
    return number_lines(cut(rows)).select("app", "line", "value")


def report_lines(compare: DataFrame) -> DataFrame:
    """(app, kind_order, key, value): ``[f](tag) key truth/pred`` lines; upper-case letters are mismatches, ``?`` is absent."""
    order = F.expr("array_position(array('p','c','f','m'), kind)")
    flag = F.when(F.col("matched"), F.col("kind")).otherwise(F.upper("kind"))
    tag = F.when(F.col("is_lib"), "3lib").otherwise("degd")
    line = F.format_string("[%s](%s) %s %s/%s", flag, tag, F.col("key"), F.coalesce("truth", F.lit("?")), F.coalesce("pred", F.lit("?")))
    return compare.select("app", order.alias("kind_order"), "key", line.alias("value"))


def write_compare_report(compare: DataFrame, path: str, mode: str = "error") -> None:
    """A folder per app with its report lines in order."""
    lines = report_lines(compare).repartition("app").sortWithinPartitions("app", "kind_order", "key")
    lines.select("app", "value").write.mode(mode).partitionBy("app").text(path)


def parse_compare_lines(lines: DataFrame) -> DataFrame:
    """(app, kind, matched, is_lib, key, truth, pred) of report lines, with or without the tag; other lines go.

    The tag is compared without regard to case.
    """
    # the form of a report line: a fixed value
    pattern = r"^\[([a-zA-Z])\](?:\(([^)]*)\))? (.*) ([^/ ]*)/([^/ ]*)$"
    g = lambda i: F.regexp_extract("value", pattern, i)
    got = lines.where(F.col("value").rlike(pattern))
    side = lambda i: F.when(g(i) != "?", g(i))
    return got.select("app", F.lower(g(1)).alias("kind"), (g(1) == F.lower(g(1))).alias("matched"), F.upper(g(2)).isin("3LIB", "LIB").alias("is_lib"), g(3).alias("key"), side(4).alias("truth"), side(5).alias("pred"))


def load_compare_reports(spark: SparkSession, path: str, file_glob: str = "*", app_pattern: str = r"([^/]+?)(?:\.[^/.]*)?$") -> DataFrame:
    lines = load_lines(spark, path, file_glob).withColumn("app", F.regexp_extract("app", app_pattern, 1))
    return parse_compare_lines(lines)


def score_table(lines: DataFrame) -> DataFrame:
    """(app, end_score, edge_count, score): the last of each per log; without edges the score is 1."""
    end = F.regexp_extract("value", r"End score\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*$", 1)
    count = F.regexp_extract("value", r"Edge count\s+([0-9]+)\s*$", 1)
    found = lines.select("app", "line", end.try_cast("double").alias("e"), count.try_cast("long").alias("c"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    both = found.groupBy("app").agg(last("e").alias("end_score"), last("c").alias("edge_count")).where("end_score IS NOT NULL AND edge_count IS NOT NULL")
    return both.withColumn("score", F.when(F.col("edge_count") <= 0, F.lit(1.0)).otherwise(F.col("end_score") / F.when(F.col("edge_count") > 0, F.col("edge_count"))))


def load_score_logs(spark: SparkSession, path: str) -> DataFrame:
    return score_table(load_lines(spark, path))


def parse_word_freq(lines: DataFrame, min_freq: int = 0) -> tuple[DataFrame, DataFrame]:
    """(word, freq) of ``freq word`` lines above ``min_freq``, and the lines that are not so."""
    pattern = r"^([0-9]+) (.*)$"
    good = lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 2).alias("word"), F.regexp_extract("value", pattern, 1).cast("long").alias("freq"))
    return good.where(F.col("freq") > min_freq), lines.where(~F.col("value").rlike(pattern) & (F.trim("value") != ""))


def load_word_freq(spark: SparkSession, path: str, min_freq: int = 0) -> DataFrame:
    return parse_word_freq(load_lines(spark, path), min_freq)[0]


def render_mapping(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(app, cls, block): a class header, then changed fields, then changed methods.

    ``classes(app, cls, pred)``; ``members(app, cls, kind: f or m, ord, type, name, params, pred)``.  Classes where
    nothing changed are dropped.  ``write_mapping`` orders blocks by the predicted class name, case ignored.
    """
    sig = F.when(F.col("kind") == "m", F.concat(F.col("name"), F.lit("("), F.coalesce("params", F.lit("")), F.lit(")"))).otherwise(F.col("name"))
    line = F.concat(F.lit("    "), F.col("type"), F.lit(" "), sig, F.lit(" -> "), F.col("pred"))
    changed = members.where(F.col("pred") != F.col("name")).select("app", "cls", F.struct("kind", "ord", line.alias("line")).alias("m"))
    body = changed.groupBy("app", "cls").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]).alias("lines"))
    joined = classes.join(body, ["app", "cls"], "left").where(F.col("lines").isNotNull() | (F.col("cls") != F.col("pred")))
    head = F.concat(F.col("cls"), F.lit(" -> "), F.col("pred"), F.lit(":"))
    return joined.select("app", "cls", "pred", F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("block"))


def write_mapping(blocks: DataFrame, path: str, mode: str = "error") -> None:
    blocks.repartition("app").sortWithinPartitions("app", F.lower("pred"), "cls").select("app", F.col("block").alias("value")).write.mode(mode).partitionBy("app").text(path)
