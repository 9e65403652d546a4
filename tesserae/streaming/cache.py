"""A result cache over a stream: lifetimes by keyed state that timers free, late results dropped by a watermark, counters.

A result is stored at an event whose key has none alive, and lives for some days from that event's time; hits don't
prolong it.  State is one row a key, freed by an event-time timer once the watermark has passed the lifetime.  An event
behind the stored one, which only comes in a later batch than it should, is answered by itself and stores nothing; one
older than the watermark is dropped by the engine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserae.streaming import runs

# The driver starts a worker of its own for stateful processors, which has no packages that were added later.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIFETIME_DAYS = 7
EVENTS = "event_id long, ts timestamp, event_type string, props string"
REPLIES = "key string, event_id long, hit boolean, stored_id long"
COUNTS = "key string, enqueued long, hits long"
#: Replies that a processor hands out at a time.
REPLY_ROWS = 50_000


def serve(events: np.ndarray, times: np.ndarray, alive: int, stored: int | None, since: int | None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Replies to one key's events in the order of time: which are hits, and the event that stored each result; and what is stored then.

    One step for each stored result, not for each event.
    """
    hit, by = np.zeros(len(events), bool), events.copy()
    at = 0
    if since is not None:
        at = int(np.searchsorted(times, since, "left"))  # what is behind the stored result is answered by itself
        end = int(np.searchsorted(times, since + alive, "right"))
        hit[at:end], by[at:end] = True, stored
        at = max(at, end)
    while at < len(events):
        stored, since = int(events[at]), int(times[at])
        end = int(np.searchsorted(times, since + alive, "right"))
        hit[at + 1 : end], by[at:end] = True, stored
        at = end
    return hit, by, stored, since


class Cache(StatefulProcessor):
    """The stored result of a key: the event that stored it, and its time in microseconds."""

    def __init__(self, alive: int):
        self.alive = alive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stored", "event_id long, since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key's events of one batch, two numbers each
        parts = [(b["event_id"].to_numpy(np.int64), b["at"].to_numpy(np.int64)) for b in rows]
        events, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((events, times))
        events, times = events[order], times[order]
        before = self.state.get() if self.state.exists() else None
        hit, by, stored, since = serve(events, times, self.alive, *(before or (None, None)))
        if before is None or since != before[1]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((since + self.alive) // 1000 + 1)
            self.state.update((stored, since))
        for at in range(0, len(events), REPLY_ROWS):
            part = slice(at, at + REPLY_ROWS)
            yield pd.DataFrame({"key": key[0], "event_id": events[part], "hit": hit[part], "stored_id": by[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="object"), "event_id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="bool"), "stored_id": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def answer(spark: SparkSession, source: str, base: str, lifetime_days: float = LIFETIME_DAYS, delay: str = "0 seconds") -> StreamingQuery:
    """Replies to all events that are in the folder `source` and weren't answered yet, under base/out.  Run it again when more have come."""
    events = spark.readStream.schema(EVENTS).parquet(source)
    key = F.sha2(F.concat_ws("\0", "event_type", "props"), 256).alias("key")
    keyed = events.withWatermark("ts", delay).select(key, "event_id", "ts", F.unix_micros("ts").alias("at"))
    replies = keyed.groupBy("key").transformWithStateInPandas(Cache(int(lifetime_days * 86_400_000_000)), REPLIES, "append", "EventTime")
    with runs.large_state(spark):
        return runs.to_files(replies, base)


def replies(spark: SparkSession, events: DataFrame, lifetime_days: float = LIFETIME_DAYS, steps: int = 4) -> DataFrame:
    """Per event whether its key's stored result is still alive, and which event stored it.  The events come in `steps` batches of rising time, each by a run of its own."""
    source, base = runs.folder(spark, "events"), runs.folder(spark, "replies")
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")
    for _ in runs.in_steps(rows, "ts", steps, source):
        answer(spark, source, base, lifetime_days)
    return spark.read.schema(REPLIES).parquet(f"{base}/out")


def count(spark: SparkSession, replies_folder: str, base: str) -> StreamingQuery:
    """Keeps a table of counts by key under base/counts: an aggregate whose changed rows each batch writes once."""
    stream = spark.readStream.schema(REPLIES).option("maxFilesPerTrigger", 64).parquet(replies_folder)
    found = stream.groupBy("key").agg(F.count("*").alias("enqueued"), F.count_if("hit").alias("hits"))
    return runs.finish(found.writeStream.outputMode("update").foreachBatch(runs.to_batches(f"{base}/counts")), f"{base}/state")


def counters(spark: SparkSession, found: DataFrame, steps: int = 3) -> DataFrame:
    """How many events came, how many were served from the cache, their share, and how many keys there are; from a table that a stream keeps."""
    source, base = runs.folder(spark, "replies"), runs.folder(spark, "counters")
    for i in range(steps):
        found.where(F.pmod(F.xxhash64("event_id"), F.lit(steps)) == i).write.mode("append").parquet(source)
        count(spark, source, base)
    table = runs.latest(spark, f"{base}/counts", COUNTS, ["key"])
    return table.agg(F.sum("enqueued").alias("enqueued"), F.sum("hits").alias("hits"), (F.sum("hits") / F.sum("enqueued")).alias("hit_rate"), F.count("*").alias("n_keys"))


def in_time(spark: SparkSession, batches: list[DataFrame], delay: str) -> DataFrame:
    """The results (event_id, ts) of batches that come one after another, each written in parallel and run by itself; what is older than the watermark of the batches before is dropped."""
    source, base = runs.folder(spark, "late"), runs.folder(spark, "in-time")
    for df in batches:
        df.select("event_id", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id long, ts timestamp").parquet(source)
        runs.to_files(stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]), base)
    return spark.read.schema("event_id long, ts timestamp").parquet(f"{base}/out")


def resumed(spark: SparkSession, source: str, schema: str, key: str, path: str, state: str) -> StreamingQuery:
    """Appends the rows of new files to a table of batches, each `key` once, however often a batch or a row comes."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    return runs.finish(stream.writeStream.foreachBatch(runs.to_batches(path, key)), state)
