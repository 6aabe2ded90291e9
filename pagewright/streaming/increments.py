"""Incremental builds: new volumes appended as they land, and windowed counts of an event stream.

The corpus operators are batch; these carry their tables forward with Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_volumes(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of landed rows is built and written under its batch id; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], length: str, late: str) -> DataFrame:
    """(start, by, n): counts per window; rows later than the watermark are dropped."""
    some = events.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))
    return some.select(F.col("window.start").alias("start"), *by, "n")


def user_sessions(events: DataFrame, time: str, user: str, gap: str, late: str) -> DataFrame:
    """(user, start, end, n): sessions closed by a gap."""
    some = events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return some.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
