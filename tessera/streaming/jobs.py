"""Job states kept in a stream: the last write of each job, what polls of it found, and its expiry by an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from tessera.streaming.events import drain

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField("status", StringType()), StructField("written", TimestampType()), *[StructField(c, IntegerType()) for c in ("writes", "hits", "misses")], StructField("version", LongType())])
UPDATES = StructType([StructField("job", LongType()), *STATE.fields])
EXPIRED = "expired"


class JobStates(StatefulProcessor):
    """One state a job. A write sets the status and the age; a poll finds the status if its last write is at most `ttl` old.

    Rows of a batch are taken by time, writes before polls of the same time. The timer of the last write's end of life replaces those of earlier writes; when the watermark passes it,
    the job expires: its status goes, its counts stay for the last update.
    """

    def __init__(self, ttl: timedelta):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _row(self, key: tuple, state: tuple) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], *state)], columns=UPDATES.names).astype({"written": "datetime64[us]"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "is_poll", "event_id"])
        status, written, writes, hits, misses, version = self.state.get() if self.state.exists() else (None, None, 0, 0, 0, 0)
        for ts, is_poll, said in zip(events["ts"], events["is_poll"], events["status"]):
            ts = ts.to_pydatetime()
            if not is_poll:
                status, written, writes = said, ts, writes + 1
            elif status not in (None, EXPIRED) and ts - written <= self.ttl:
                hits += 1
            else:
                misses += 1
        state = (status, written, writes, hits, misses, version + 1)
        self.state.update(state)
        if written is not None and status != EXPIRED:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((written + self.ttl).timestamp() * 1000))
        yield from self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, written, writes, hits, misses, version = self.state.get()
        state = (EXPIRED, written, writes, hits, misses, version + 1)
        self.state.update(state)
        yield from self._row(key, state)


def job_updates(events: DataFrame, ttl: timedelta, late: str = "2 hours") -> DataFrame:
    """The stream of states of the jobs of `events` (job, event_id, ts, is_poll, status), one row for each change."""
    e = events.select("job", "event_id", "ts", "is_poll", "status").withWatermark("ts", late)
    return e.groupBy("job").transformWithStateInPandas(JobStates(ttl), UPDATES, "Append", "EventTime")


def drain_jobs(updates: DataFrame, folder: str) -> DataFrame:
    """`events.drain` with the state store that timers need, which is set for the start of this stream only."""
    spark = updates.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return drain(updates, folder, "append")
    finally:
        spark.conf.set(STORE, before)


def last_states(updates: DataFrame) -> DataFrame:
    rest = [c for c in UPDATES.names if c != "job"]
    return updates.groupBy("job").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("job", "s.*")


