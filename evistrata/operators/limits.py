"""Sliding-window limits and daily ceilings over event logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


#: Accepted events and seconds of the limits by name.
LIMITS = {"paid": (5, 600), "free": (30, 600), "reads": (120, 60)}


class SlidingWindow:
    """Accepts an event if fewer than ``most`` accepted ones are at most ``window`` old; a rejected event
    leaves no trace. ``most`` of 0 or less accepts everything."""

    def __init__(self, most: int, window: float):
        self.most, self.window = most, window
        self.accepted: deque[float] = deque()

    def allow(self, now: float) -> bool:
        if self.most <= 0:
            return True
        while self.accepted and now - self.accepted[0] > self.window:
            self.accepted.popleft()
        if len(self.accepted) >= self.most:
            return False
        self.accepted.append(now)
        return True


def rate_limited(events: DataFrame, *, key: str, at: str, most: int, window_seconds: float, order: str) -> DataFrame:
    """``events`` with ``allowed``. Whether an event is accepted depends on the decisions before it, so the
    events of a key are one sequence; they are streamed in the order of time and ``order``, and the state
    is at most ``most`` times."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", allowed boolean"
    names = events.columns

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limit = object(), SlidingWindow(most, window_seconds)
        for batch in batches:
            allowed = []
            for k, s in zip(batch[key], batch["__s"]):
                if k != current:
                    current, limit = k, SlidingWindow(most, window_seconds)
                allowed.append(limit.allow(s))
            yield batch[names].assign(allowed=allowed)

    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__s", seconds)
    return rows.repartition(key).sortWithinPartitions(key, "__s", order).mapInPandas(decide, kinds)


def daily_ceiling(events: DataFrame, *, at: str, counts: Column, most: int, order: str) -> DataFrame:
    """``events`` with ``day``, ``used`` (counting events of the day up to it) and ``within`` the ceiling.

    The running count of a day is the count of its earlier hours plus a running count inside the hour, so
    no task sorts more than one hour of events.
    """
    rows = events.withColumn("day", F.to_date(at)).withColumn("__h", F.hour(at)).withColumn("__c", F.when(counts, 1).otherwise(0))
    hours = rows.groupBy("day", "__h").agg(F.sum("__c").alias("__n"))
    earlier = Window.partitionBy("day").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("day", "__h", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("day", "__h").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(hours, ["day", "__h"]).withColumn("used", F.sum("__c").over(inside) + F.col("__before"))
    return joined.withColumn("within", (F.col("__c") == 0) | (F.col("used") <= most)).drop("__h", "__c", "__before")
