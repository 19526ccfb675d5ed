"""Structured Streaming: changed-frame sessions and continuous intake of journals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def change_sessions(frames: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Runs of changed frames (media_id, ts, changed) of an arriving stream, closed by a longer gap; frames later than the watermark are dropped."""
    s = frames.where("changed").withWatermark("ts", late).groupBy("media_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    return s.select("media_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "frames")


def intake(stream: DataFrame, key: str, done_path: str, report_path: str, validate: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Journals as they arrive: those in the done list are skipped, the rest validated, messages and the done list appended.

    Each batch has a folder of its own in both, which it overwrites when it is run again after a failure; so its messages are there once.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.read.schema(f"{batch.select(key).schema[0].simpleString().replace(':', ' ')}, batch long").parquet(done_path) if _exists(spark, done_path) else None
        todo = batch if done is None else batch.join(done.where(F.col("batch") != number).select(key).distinct(), key, "left_anti")
        todo = todo.persist()
        validate(todo).write.mode("overwrite").parquet(f"{report_path}/batch={number}")
        todo.select(key).distinct().write.mode("overwrite").parquet(f"{done_path}/batch={number}")
        todo.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
