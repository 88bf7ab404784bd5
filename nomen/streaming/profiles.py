"""Incremental profile counts and live score logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nomen.operators.profiles import add_counts, profile_counts

PROFILE = "sig string, id string"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PROFILE).json(path)


def streamed_counts(stream: DataFrame) -> DataFrame:
    """Running counts by (sig, id); the output mode is ``update`` or ``complete``.  No watermark: totals never expire."""
    return profile_counts(stream)


def keep_totals(stream: DataFrame, path: str, checkpoint: str, compact_every: int = 50):
    """Writes each batch's counts as a folder of its own, named by the batch: repeating a batch after a loss overwrites it, so
    that it counts once.  After ``compact_every`` batches those before are added up into one folder, and the batch's
    folder says what it stands for, so that ``read_totals`` never counts a row twice."""

    def add(batch: DataFrame, number: int) -> None:
        new = profile_counts(batch)
        if number and number % compact_every == 0:
            old = read_totals(batch.sparkSession, path, number)
            add_counts(old, new).write.mode("overwrite").parquet(f"{path}/total={number}")
        else:
            new.write.mode("overwrite").parquet(f"{path}/delta={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def read_totals(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(sig, id, count): the last compacted total and the batches after it (all, or those before a batch)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    parts = [(kind, int(n)) for kind, _, n in (x.partition("=") for x in names) if kind in ("total", "delta") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}/_SUCCESS"))]
    parts = [(kind, n) for kind, n in parts if before is None or n < before]
    base = max((n for kind, n in parts if kind == "total"), default=-1)
    folders = [f"{path}/{kind}={n}" for kind, n in parts if (kind == "total" and n == base) or (kind == "delta" and n > base)]
    schema = f"{PROFILE}, count long"
    found = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return add_counts(found, found.limit(0))


def score_blocks(lines: DataFrame, silent_ms: int | None = None) -> DataFrame:
    """(log, end_score, edge_count), once per ``End score`` line of ``lines(log, value)``: the state holds the last edge
    count that a log showed.  With a column ``line``, the lines of a batch are taken in its order.

    A block that has ended leaves no state.  With ``silent_ms``, neither does a log that shows nothing for so many milliseconds: what it
    shows later starts a new block, whose edge count is null until it shows one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count = state.get[0] if state.exists else None
        out = []
        ordered = pd.concat(list(batches), ignore_index=True)
        if "line" in ordered:
            ordered = ordered.sort_values("line")
        for value in ordered["value"]:
            if value is not None:
                if value.startswith("Edge count "):
                    count = int(value.split()[-1])
                elif value.startswith("End score "):
                    out.append((key[0], float(value.split()[-1]), count))
                    count = None
        if count is not None:
            state.update((count,))
            if silent_ms is not None:
                state.setTimeoutDuration(silent_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["log", "end_score", "edge_count"]).astype({"edge_count": "Int64"})

    timeout = GroupStateTimeout.NoTimeout if silent_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return lines.groupBy("log").applyInPandasWithState(step, "log string, end_score double, edge_count long", "count long", "append", timeout)


def edge_count_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.where(F.col(value).rlike("^(Edge count|End score) "))
