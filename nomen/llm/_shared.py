"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach: ``spark.checkpoint.dir``.

    Where that setting is missing, a session on one machine gets a temporary folder, which is set; on a cluster there
    is no folder to guess, and this raises.
    """
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="nomen-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/nomen-{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def remove_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the given folders, or all that this process has written: for when no result that reads them is wanted any more."""
    for path in list(_WRITTEN) if paths is None else paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written into the shared folder in buckets by ``key``: joins on it move the other side only."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"nomen_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay: the table's place is not the catalog's
    return found


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, written, with a number of its own for each row; and that column's name, which no column of ``df`` has."""
    column = "_row"
    while column in map(str.lower, df.columns):
        column += "_"
    return materialise(df.withColumn(column, F.monotonically_increasing_id()), name), column


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` without a broadcast, for sides that grow with the corpus.

    Spark takes written tables for as small as their compressed files, and rows that Python or an explode makes of one row
    for about as small as that row: it would gather and broadcast gigabytes.
    """
    return left.join(right.hint("merge"), on, how)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what this process has freed to the system: Python workers live on through other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def make_room() -> None:
    """Drop the words that a packing task before this one has left in the process: for tasks that do not tokenise."""
    packing = sys.modules.get("nomen.llm.packing")
    if packing is not None and packing.encoder.cache_info().currsize:
        packing.encoder.cache_clear()
        give_back()
