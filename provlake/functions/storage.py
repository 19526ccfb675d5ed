"""Cutting lineage in loops: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of this process's tables.
_PATHS: list[str] = []


def clear_written(spark: SparkSession) -> None:
    """Delete the tables that this process has written. Results that read them must have been used or saved before."""
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut, its size is known to the optimizer, and lost
    executors cost nothing. What was written already is returned as it is."""
    if hasattr(df, "_written_at"):
        return df
    path = f"{shared_dir(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def picked(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of df; of a table that was written they are not written again."""
    out = df.select(*columns)
    if hasattr(df, "_written_at"):
        out._written_at = df._written_at
    return out


class Rounds:
    """The rounds of a loop as partitions of one table, so that what all rounds have found is one scan, whatever the depth."""

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.schema, self.count = first.sparkSession, first.schema, 0
        self.path = f"{shared_dir(self.spark)}/steps/{uuid.uuid4().hex}"
        _PATHS.append(self.path)
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Write one more round, and read it again."""
        path = f"{self.path}/round={self.count}"
        df.write.parquet(path)
        self.count += 1
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)
