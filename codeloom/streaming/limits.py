"""The sliding-window limit as a stream: state holds the times of admitted events alone, at most the limit, and a timer drops it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Limiter(StatefulProcessor):
    """Admits an event while fewer than ``limit`` admitted ones lie in the window before it; denied events leave no trace.

    Events of a batch are taken in order of time, then ``tie``. Where the watermark passes the end of the newest admitted event's window,
    the key's state goes.
    """

    def __init__(self, key: str, time: str, tie: str, limit: int, seconds: float):
        self.key, self.time, self.tie, self.limit, self.width = key, time, tie, limit, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.times.get()] if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values([self.time, self.tie], kind="stable")
        allowed = []
        for at in batch[self.time].astype("datetime64[us]").astype("int64").tolist():
            held = [t for t in held if t >= at - self.width]  # an event just as old as the window still counts
            allowed.append(len(held) < self.limit)
            if allowed[-1]:
                held.append(at)
        if held:
            self.times.put([(t,) for t in held])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held[-1] + self.width) // 1000 + 1)
        else:
            self.times.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(batch), self.tie: batch[self.tie].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def sliding_limit_stream(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: float, late: str) -> DataFrame:
    """(key, tie, allowed) as ``events.sliding_limit``, for events whose batches come in order of time; those later than ``late`` are dropped.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    slim = events.withWatermark(time, late).select(key, tie, time)
    return slim.groupBy(key).transformWithStateInPandas(Limiter(key, time, tie, limit, seconds), f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean", "append", "eventTime")
