"""Stateful streams: limits per key, daily counts, and append-once sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evistrata.operators.limits import SlidingWindow


def rate_limited_stream(events: DataFrame, *, key: str, at: str, event: str, most: int, window_seconds: float, late: str = "1 minute") -> DataFrame:
    """``key, event, at_seconds, allowed`` of a stream of events, by the same rule as the batch operator.

    The state of a key is the times of its accepted events, at most ``most``; it is dropped when the
    watermark has passed its last event by more than the window. Events are decided in the order of their times within a micro-batch,
    and as they come between micro-batches.
    """
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    seconds = F.unix_micros("__at") / 1e6
    rows = timed.select(F.col(key).cast("string").alias("key"), F.col(event).cast("string").alias("event"), seconds.alias("at_seconds"), "__at")

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limit = SlidingWindow(most, window_seconds)
        if state.exists:
            limit.accepted.extend(state.get[0])
        batch = pd.concat(list(frames)).sort_values(["at_seconds", "event"], kind="stable")[["event", "at_seconds"]]
        allowed = [limit.allow(t) for t in batch["at_seconds"]]
        state.update((list(limit.accepted),))
        ends = int(1_000 * (batch["at_seconds"].max() + window_seconds)) + 1_000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield batch.assign(key=key[0], allowed=allowed)[["key", "event", "at_seconds", "allowed"]]

    return rows.groupBy("key").applyInPandasWithState(
        decide, "key string, event string, at_seconds double, allowed boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def daily_counts_stream(events: DataFrame, *, at: str, late: str = "1 hour") -> DataFrame:
    """Events per UTC day; a day is final once the watermark has passed it."""
    rows = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return rows.groupBy(F.window("__at", "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def windowed_values(events: DataFrame, *, at: str, by: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum per event-time window and group; works on streams and tables alike."""
    rows = events.withColumn("__at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("__at", late) if events.isStreaming else rows
    return rows.groupBy(F.window("__at", size, slide or size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def append_once(stream: DataFrame, path: str, checkpoint: str, *, key: str):
    """Append new keys of a stream to a parquet table, each once, also after a restart.

    A micro-batch is written under its number; one that is run again replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.parquet(path).where(F.col("batch") != number).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
