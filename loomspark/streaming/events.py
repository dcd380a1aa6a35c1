"""Streams of events: windowed counts, sessions, running states, and delta appends.

Every function takes a streaming or a batch DataFrame with the columns of ``events``; what a stream gives when it has
read everything equals the batch result, apart from rows later than the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file source that reads each new Parquet file once; ``folder`` may be a pattern."""
    return spark.readStream.schema(schema).parquet(folder)


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events, late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; a stream forgets the ids that are older than the watermark, a batch never has to."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) so far: a plain aggregate, whose state a stream keeps for each user."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_log(stream: DataFrame, to_records: Callable[[DataFrame], DataFrame], log: str, checkpoint: str):
    """Append each micro-batch to the object log at ``log``, in a folder of its own: a batch that is repeated after a
    failure overwrites its own folder, so the log holds every record once."""

    def write(batch: DataFrame, number: int) -> None:
        to_records(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
