"""Scans along the lines of files that may be larger than a task: what holds from one line on, carried over block borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomen.functions.columns import free_name

BLOCK_LINES = 1 << 16


def carry_down(lines: DataFrame, value: Column, out: str, key: str = "app", order: str = "line", block_lines: int = BLOCK_LINES) -> DataFrame:
    """``lines`` with ``out``: the last ``value`` that is not null, at a line or before it, within ``key``.

    Lines are scanned in blocks of ``block_lines`` numbers.  A block's last value is one row, and only these rows are scanned
    along the whole file: the value that a block begins with is joined to its lines.  Lines without a value before them
    have null; of equal line numbers any order counts; a null key is a file of its own.
    """
    block, own, before, k, b = (free_name([*lines.columns, out], name) for name in ("block", "own", "before", "of_key", "of_block"))
    marked = lines.withColumn(own, value).withColumn(block, F.floor(F.col(order) / block_lines))
    down = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = marked.groupBy(key, block).agg(F.max_by(own, F.when(F.col(own).isNotNull(), F.col(order))).alias(before))
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias(k), F.col(block).alias(b), F.last(before, ignorenulls=True).over(earlier).alias(before))
    scanned = marked.withColumn(own, F.last(own, ignorenulls=True).over(down))
    joined = scanned.join(ends, F.col(key).eqNullSafe(F.col(k)) & (F.col(block) == F.col(b)), "left")
    return joined.withColumn(out, F.coalesce(own, before)).select(*lines.columns, out)


def number_lines(rows: DataFrame, file: str = "app", start: str = "start", row: str = "row") -> DataFrame:
    """``rows(file, start, row, ...)`` with ``line``, from 0 in each file: ``start`` is where a line's split begins in its file, and ``row``
    a number that rises within the split.

    Lines of a split are counted; each split's first line number is the sum of the counts of those before it.
    """
    splits = rows.groupBy(file, start).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("least"))
    before = F.sum("n").over(Window.partitionBy(file).orderBy(start)) - F.col("n")
    return rows.join(splits.select(file, start, "least", before.alias("before")), [file, start]).withColumn("line", F.col("before") + F.col(row) - F.col("least")).drop("before", "least")
