"""Admission by a sliding window that counts admitted events only: request rates and uploads per session.

Whether an event is admitted depends on earlier admissions, so a window count over all events is not enough.
What can be settled without that order is: time is cut where a key is silent for longer than the window, and
stretches whose total stays within the limit are admitted as they are. Only busy stretches are walked in
order, as a sorted stream with at most ``limit`` times held.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvault import fixed_values as V


class Admission:
    """The live admissions of one key."""

    def __init__(self, limit: int, ends: list[int] = ()):
        self.limit = limit
        self.ends = deque(ends)

    def offer(self, now: int, end: int) -> bool:
        """Admit an event at ``now`` that counts up to and including ``end``, if there is room."""
        if any(e < now for e in self.ends):
            self.ends = deque(e for e in self.ends if e >= now)
        if len(self.ends) >= self.limit:
            return False
        self.ends.append(end)
        return True


def admit(events: DataFrame, keys: list[str], ts: str, limit: Column, window_seconds: int,
          released: Column | None = None) -> DataFrame:
    """Add ``admitted`` to events. An event counts for ``window_seconds``, or until it is ``released``.

    ``limit`` must be constant per key. Events at the same instant go in order of ``event_id``.
    """
    width = window_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withColumn("_at", at).withColumn("_limit", limit.cast("int"))
    end = F.col("_at") + width
    if released is not None:
        end = F.least(end, F.coalesce(F.unix_micros(released.cast("timestamp")) - 1, end))
    rows = rows.withColumn("_end", end).withColumn("_bucket", F.floor(F.col("_at") / width))

    # silences: one row per key and window length, however many events a key has
    buckets = rows.groupBy(*keys, "_bucket").agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("c"), F.max("_limit").alias("l"))
    in_time = Window.partitionBy(*keys).orderBy("_bucket")
    gap = F.col("first") - F.lag("last").over(in_time)
    cut = buckets.withColumn("_stretch", F.sum(F.when(gap > width, 1).otherwise(0)).over(
        in_time.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("c").over(Window.partitionBy(*keys, "_stretch"))
    cut = cut.select(*keys, "_bucket", "_stretch", (total > F.col("l")).alias("_busy"))
    rows = rows.join(cut, [*keys, "_bucket"])

    columns = events.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", admitted boolean"
    busy = rows.filter("_busy").repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_at", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            verdicts = []
            heads = zip(*(batch[c] for c in [*keys, "_stretch"]))
            for head, now, until, most in zip(heads, batch["_at"], batch["_end"], batch["_limit"]):
                if head != current:
                    current, state = head, Admission(most)
                verdicts.append(state.offer(now, until))
            yield batch[columns].assign(admitted=verdicts)

    quiet = rows.filter(~F.col("_busy")).select(*columns, F.lit(True).alias("admitted"))
    return quiet.unionByName(busy.mapInPandas(walk, schema))


def rate_limited(requests: DataFrame, reads: int = V.READS_PER_MIN, writes: int = V.WRITES_PER_MIN,
                 window_seconds: int = 60) -> DataFrame:
    """Requests (event_id, client, method, ts) with ``admitted``; writes are limited harder than reads."""
    kind = F.when(F.col("method") == "POST", "POST").otherwise("GET")
    limit = F.when(F.col("kind") == "POST", writes).otherwise(reads)
    return admit(requests.withColumn("kind", kind), ["client", "kind"], "ts", limit, window_seconds).drop("kind")
