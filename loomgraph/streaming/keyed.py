"""Greedy limits and circuit breakers over a stream: keyed state with timers (``transformWithState``).

Each key's state is a value in the state store; rows of a micro-batch are taken in order of time. A timer clears what no later
row can need, so idle keys take no room. After a stop the next run goes on from the checkpoint. The session needs the RocksDB
state store (``STORE``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class GreedyLimit(StatefulProcessor):
    """At most ``limit`` allowed rows within any trailing window; the state is the times of the allowed ones."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = deque(self.kept.get()[0] if self.kept.exists() else ())
        for r in sorted(rows, key=lambda r: (r["t"], r["tie"])):
            while kept and kept[0] <= r["t"] - self.seconds:
                kept.popleft()
            allowed = len(kept) < self.limit
            if allowed:
                kept.append(r["t"])
            yield Row(key=key[0], tie=r["tie"], allowed=allowed)
        if kept:
            self.kept.update((list(kept),))
            self.handle.registerTimer(int((kept[-1] + self.seconds) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists() and (self.kept.get()[0][-1] + self.seconds) * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()  # else a later row has set a later timer
        return iter(())

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """closed, open or half_open after each call; a success takes a failure back. A closed breaker without failures has no state."""

    def __init__(self, failures: int, rest: float, successes: int) -> None:
        self.failures, self.rest, self.successes = failures, rest, successes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, bad int, good int, since double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, bad, good, since = self.state.get() if self.state.exists() else ("closed", 0, 0, 0.0)
        for r in sorted(rows, key=lambda r: (r["t"], r["tie"])):
            if state == "open" and r["t"] - since >= self.rest:
                state, good = "half_open", 0
            if state != "open" and r["failed"]:
                bad += 1
                if state == "half_open" or bad >= self.failures:
                    state, since = "open", r["t"]
            elif state != "open":
                bad, good = max(0, bad - 1), good + 1
                if state == "half_open" and good >= self.successes:
                    state, bad = "closed", 0
            yield Row(key=key[0], tie=r["tie"], state=state)
        if (state, bad) == ("closed", 0):
            self.state.clear()
        else:
            self.state.update((state, bad, good, since))

    def close(self) -> None:
        pass


def _rows(events: DataFrame, key: str, time: str, tie: str, late: str, *more) -> DataFrame:
    ship(events.sparkSession)
    ts = F.col(time).cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), ts.alias("ts"), ts.cast("double").alias("t"), *more)
    return rows.withWatermark("ts", late)


def greedy_limit(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, tie, allowed) of a stream whose batches come in order of time; keys as text, ``tie`` a whole number.

    A constant key makes one budget of all rows.
    """
    grouped = _rows(events, key, time, tie, late).groupBy("key")
    return grouped.transformWithState(GreedyLimit(limit, seconds), "key string, tie long, allowed boolean", "append", "eventTime")


def breaker(events: DataFrame, key: str, time: str, tie: str, failed, failures: int = 5, rest: float = 60.0, successes: int = 3, late: str = "10 minutes") -> DataFrame:
    """(key, tie, state) after each call of a stream whose batches come in order of time."""
    grouped = _rows(events, key, time, tie, late, failed.alias("failed")).groupBy("key")
    return grouped.transformWithState(Breaker(failures, rest, successes), "key string, tie long, state string", "append", "none")
