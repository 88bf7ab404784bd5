"""Cutting the lineage of loops and of tables that several branches of a query read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share.

    Where that setting is missing, a session on one machine gets a temporary folder, which is set; on a cluster this
    raises.
    """
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="nomen-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def new_folder(spark: SparkSession, name: str = "cut") -> str:
    """A folder of its own in the shared one; ``remove_written`` knows it."""
    _WRITTEN.append(f"{shared_folder(spark)}/nomen-{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    The new scan has sizes that joins can be planned by, and survives lost executors.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Log:
    """A written table that rows are added to: what a loop has found so far, without a rewrite per round."""

    def __init__(self, rows: DataFrame):
        self._spark, self._schema, self._paths = rows.sparkSession, rows.schema, []
        self.add(rows)

    def add(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` too; what comes back reads them alone."""
        path = new_folder(self._spark, "log")
        rows.select(*self._schema.names).write.parquet(path)
        self._paths.append(path)
        return self._spark.read.schema(self._schema).parquet(path)

    def read(self) -> DataFrame:
        """All rows added so far; later ones are not in this table."""
        return self._spark.read.schema(self._schema).parquet(*self._paths)


def stored(spark: SparkSession, folder: str) -> bool:
    """Is there a finished table in this folder?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove_written(spark: SparkSession) -> None:
    """Delete all that this process has written: for when no result that reads it is wanted any more."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
