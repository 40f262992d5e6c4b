"""Each scope's last event and its chain of events as streams, with state in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brindle.functions.dates import days_between

#: The only state store that keeps several values and timers of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINK = "scope LONG, event_id LONG, next_id LONG, ts LONG, next_ts LONG"
LAST = "scope LONG, event_id LONG, ts LONG, events LONG"


class Chain(StatefulProcessor):
    """Links neighbouring events of a scope by (time in microseconds, id).

    An event waits until the watermark has passed its time, so that no earlier one can come; a timer at the earliest waiting event
    wakes the scope, and all events that the watermark has passed are then linked at once. A repeated event is known by its id while it
    waits; what lies at or before the last linked event is late and left out.

    Every call of the state store is a message to Spark, and every value of it is packed and unpacked, so none is made for a single event:
    a scope's new events of a batch wait as one value, an id and a time each, and repeats are found when the scope wakes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id LONG, ts LONG")
        self.alarm = handle.getValueState("alarm", "at LONG")
        self.waiting = handle.getListState("waiting", "events BINARY")

    def _wake_at(self, ts: int | None) -> None:
        """One timer a scope: at the earliest waiting event."""
        old = self.alarm.get()
        if old is not None:
            if ts is not None and old[0] <= ts // 1000:
                return
            self.handle.deleteTimer(old[0])
            self.alarm.clear()
        if ts is not None:
            self.handle.registerTimer(ts // 1000)
            self.alarm.update((ts // 1000,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        done = self.last.get()
        fresh = np.concatenate([frame[["event_id", "ts"]].to_numpy(np.int64) for frame in rows])
        if done is not None:
            event, ts = fresh.T
            fresh = fresh[(ts > done[1]) | ((ts == done[1]) & (event > done[0]))]
        if len(fresh):
            self.waiting.appendValue((fresh.tobytes(),))
            self._wake_at(int(fresh[:, 1].min()))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.concatenate([np.frombuffer(some[0], np.int64).reshape(-1, 2) for some in self.waiting.get()])
        held = held[np.lexsort((held[:, 1], held[:, 0]))]
        held = held[np.append(True, held[1:, 0] != held[:-1, 0])]  # of an event that waits twice, its first time
        held = held[np.lexsort((held[:, 0], held[:, 1]))]
        passed = int(np.searchsorted(held[:, 1], mark))
        self.alarm.clear()  # the timer that fired is gone
        if passed < len(held):
            self.waiting.put([(held[passed:].tobytes(),)])
            self._wake_at(int(held[passed, 1]))
        else:
            self.waiting.clear()
        if passed:
            last, chain = self.last.get(), held[:passed]
            if last is not None:
                chain = np.concatenate([np.array([last], np.int64), chain])
            self.last.update((int(chain[-1, 0]), int(chain[-1, 1])))
            if len(chain) > 1:
                yield pd.DataFrame({"scope": key[0], "event_id": chain[:-1, 0], "next_id": chain[1:, 0], "ts": chain[:-1, 1], "next_ts": chain[1:, 1]})

    def close(self) -> None:
        pass


class Last(StatefulProcessor):
    """A scope's last event by (time, id), told whenever it changes or an event is added, with the number of events so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "event_id LONG, ts LONG, events LONG")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        event, ts, events = self.state.get() if self.state.exists() else (None, None, 0)
        for frame in rows:
            events += len(frame)
            best = frame.sort_values(["ts", "event_id"]).iloc[-1]
            if ts is None or (int(best["ts"]), int(best["event_id"])) > (ts, event):
                event, ts = int(best["event_id"]), int(best["ts"])
        self.state.update((event, ts, events))
        yield pd.DataFrame([(key[0], event, ts, events)], columns=["scope", "event_id", "ts", "events"])

    def close(self) -> None:
        pass


def _keyed(events: DataFrame, scope: str) -> DataFrame:
    """scope, event_id, ts in microseconds and the event time; events without scope, id or time are left out."""
    usable = events.where(F.col(scope).isNotNull() & F.col("event_id").isNotNull() & (F.unix_timestamp("ts") > 0))
    return usable.select(F.col(scope).cast("long").alias("scope"), "event_id", F.unix_micros("ts").alias("micros"), "ts")


def chained(events: DataFrame, scope: str = "user_id") -> DataFrame:
    """Links of each scope's neighbouring events that the watermark has passed: scope, event_id, next_id, days_diff."""
    rows = _keyed(events, scope).select("scope", "event_id", F.col("micros").alias("ts"), F.col("ts").alias("at"))
    links = rows.groupBy("scope").transformWithStateInPandas(Chain(), outputStructType=LINK, outputMode="Append", timeMode="EventTime")
    seconds = lambda c: F.expr(f"{c} div 1000000")
    return links.select("scope", "event_id", "next_id", days_between(seconds("next_ts"), seconds("ts")).alias("days_diff"))


def last_events(events: DataFrame, scope: str = "user_id") -> DataFrame:
    """Each scope's last event, a row whenever it has new events: scope, event_id, ts (microseconds), events. A stream in update mode."""
    rows = _keyed(events.dropDuplicatesWithinWatermark(["event_id"]), scope).select("scope", "event_id", F.col("micros").alias("ts"))
    return rows.groupBy("scope").transformWithStateInPandas(Last(), outputStructType=LAST, outputMode="Update", timeMode="None")
