"""Streaming admission: request rates and upload caps as keyed state.

Keys share a group and its state with the other keys of their bucket: a group costs some milliseconds in every micro-batch, however few
rows it has. A bucket's rows of one micro-batch are taken together, so ``buckets`` should grow with the keys and rows of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docvault import fixed_values as V
from docvault.operators.limits import Admission

OUTPUT = "event_id bigint, key string, kind string, ts timestamp, admitted boolean"
BUCKETS = 1024
_NO_TIME = -(1 << 63)       # an event without a time comes last


def _bucketed(events: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Events with the bucket of their keys and their time in microseconds, whatever the session's time zone."""
    return events.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("at", F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)))


def _admit_stream(events: DataFrame, limits: dict[str, int], window_seconds: int, delay: str, buckets: int) -> DataFrame:
    """``events``: (event_id, key, kind, ts). State is the admitted times of a bucket's keys inside the window.

    A key's times are dropped once the watermark is past the end of its last one, with the bucket's next rows or when all keys' are past.
    """
    width = window_seconds * 1_000_000

    def step(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rules: dict[tuple, Admission] = {}
        if state.exists:
            for key, kind, end in zip(*state.get, strict=True):
                rules.setdefault((key, kind), Admission(limits[kind])).ends.append(end)
        rows = pd.concat(list(chunks))  # one bucket's rows of one micro-batch
        rows = rows.iloc[np.lexsort((rows["event_id"], rows["at"], rows["at"] == _NO_TIME))]
        verdicts, met = [], set()
        for key, kind, now in zip(rows["key"], rows["kind"], rows["at"].tolist(), strict=True):
            own = (key, kind)
            met.add(own)
            if own not in rules:
                rules[own] = Admission(limits[kind])
            verdicts.append(rules[own].offer(now, now + width))
        past = state.getCurrentWatermarkMs()
        kept = [(*own, end) for own, rule in rules.items() if own in met or rule.ends[-1] // 1000 + 1 >= past for end in rule.ends]
        if kept:
            state.update(tuple(list(x) for x in zip(*kept, strict=True)))
            state.setTimeoutTimestamp(int(max(max(end for *_, end in kept) // 1000 + 1, past + 1)))
        elif state.exists:
            state.remove()
        yield rows[["event_id", "key", "kind", "ts"]].assign(admitted=verdicts)

    timed = _bucketed(events, buckets, "key", "kind").withWatermark("ts", delay)
    return timed.groupBy("bucket").applyInPandasWithState(
        step, OUTPUT, "keys array<string>, kinds array<string>, ends array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(requests: DataFrame, reads: int = V.READS_PER_MIN, writes: int = V.WRITES_PER_MIN,
                      window_seconds: int = 60, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Requests (event_id, client, method, ts) with the verdict."""
    kind = F.when(F.col("method") == "POST", "POST").otherwise("GET")
    events = requests.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("client").cast("string").alias("key"),
                             kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return _admit_stream(events, {"GET": reads, "POST": writes}, window_seconds, delay, buckets)


def upload_stream(uploads: DataFrame, cap: int = V.MAX_UPLOADS_PER_SESSION, ttl_seconds: int = V.UPLOAD_TTL_MIN * 60,
                  delay: str = "1 minute", deletions: DataFrame | None = None, remember_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Uploads (event_id, sid, id, created) with the verdict on the cap of live files; rows of (event_id, key, ts, admitted).

    ``deletions`` (sid, id, ts) is a second stream: a session's deletion frees its file's place from that instant on. A deletion that comes
    before its upload is remembered for ``remember_seconds``, by default as long as a file lives. Both streams are taken in the
    order of their times, deletions first; what arrives later than the watermark allows is dropped by the engine.
    """
    own = uploads.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("sid").cast("string").alias("key"), F.col("id").cast("string").alias("id"),
                         F.col("created").cast("timestamp").alias("ts"))
    events = own
    if deletions is not None:
        gone = deletions.select(F.lit(None).cast("bigint").alias("event_id"), F.col("sid").cast("string").alias("key"), F.col("id").cast("string").alias("id"),
                                F.col("ts").cast("timestamp").alias("ts"))
        events = own.unionByName(gone)
    width, memory = ttl_seconds * 1_000_000, (ttl_seconds if remember_seconds is None else remember_seconds) * 1_000_000

    def step(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Of each session: its last row's time, live files with their ends, deletions that wait for their uploads.
        sessions: dict[str | None, list] = {}
        if state.exists:
            names, lasts, of, ids, ends, early_of, early, early_at = state.get
            sessions = {name: [last, {}, {}] for name, last in zip(names, lasts, strict=True)}
            for k, file, end in zip(of, ids, ends, strict=True):
                sessions[names[k]][1][file] = end
            for k, file, at in zip(early_of, early, early_at, strict=True):
                sessions[names[k]][2][file] = at
        rows = pd.concat(list(chunks))  # one bucket's rows of one micro-batch
        rows["uploads"] = rows["event_id"].notna()
        rows = rows.iloc[np.lexsort((rows["event_id"], rows["uploads"], rows["at"]))]
        verdicts, met = [], set()
        for name, now, uploaded, file in zip(rows["key"], rows["at"].tolist(), rows["uploads"].tolist(), rows["id"], strict=True):
            met.add(name)
            session = sessions.setdefault(name, [now, {}, {}])
            live, waiting = session[1], session[2]
            session[0] = now
            for old in [k for k, e in live.items() if e < now]:
                del live[old]
            if not uploaded:
                if file in live:
                    del live[file]
                else:
                    waiting.setdefault(file, now)
                continue
            verdicts.append(len(live) < cap)
            if verdicts[-1] and file not in waiting:
                live[file] = now + width
        for name in met:
            session = sessions[name]
            session[2] = {k: t for k, t in session[2].items() if t >= session[0] - memory}
        over = {name: max([last, *live.values(), *(t + memory for t in waiting.values())]) // 1000 + 1 for name, (last, live, waiting) in sessions.items()}
        past = state.getCurrentWatermarkMs()
        kept = [(name, *sessions[name]) for name in sessions if name in met or over[name] >= past]
        files = [(k, *x) for k, (_, _, live, _) in enumerate(kept) for x in live.items()]
        gone = [(k, *x) for k, (_, _, _, waiting) in enumerate(kept) for x in waiting.items()]
        state.update(([x[0] for x in kept], [x[1] for x in kept], *([x[k] for x in files] for k in range(3)), *([x[k] for x in gone] for k in range(3))))
        state.setTimeoutTimestamp(int(max(max(over[x[0]] for x in kept), past + 1)))
        yield rows.loc[rows["uploads"], ["event_id", "key", "ts"]].astype({"event_id": "int64"}).assign(admitted=verdicts)

    return _bucketed(events, buckets, "key").withWatermark("ts", delay).groupBy("bucket").applyInPandasWithState(
        step, "event_id bigint, key string, ts timestamp, admitted boolean",
        "names array<string>, lasts array<bigint>, of array<int>, ids array<string>, ends array<bigint>, early_of array<int>, early array<string>, early_at array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout)
