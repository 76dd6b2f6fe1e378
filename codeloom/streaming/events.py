"""Keyed event logic as batch operators; the same functions run inside streams (see ``jobs``)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import period_key

#: Failures in fifteen minutes that lock a user, and an address.
THROTTLE_MINUTES, USER_FAILURES, ADDRESS_FAILURES = 15, 5, 20


def intake(events: DataFrame, keys: Sequence[str] = ("vendor", "event_id"), order: str = "received") -> DataFrame:
    """The first row of each event; replays are dropped."""
    return events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), F.col(order)).alias("r")).select(*keys, "r.*")


def late_guard(events: DataFrame, key: str, time: str, order: str, guarded: Sequence[str], open_: Sequence[str] = ()) -> DataFrame:
    """State of each key after its events in arrival order.

    An event that is older than the latest event time so far changes nothing in ``guarded``; equal or missing times apply. The stored
    time only grows. ``open_`` columns take the last non-null value whatever the time.

    So the state is that of the last arrival with the key's greatest time, or of a later arrival without a time. Both are plain aggregates,
    combined before the shuffle: a key's events never meet in one task.
    """
    values = F.struct(*guarded)
    timed = F.struct(F.col(order).alias("n"), values.alias("v"))
    state = events.groupBy(key).agg(
        F.max_by(timed, F.when(F.col(time).isNotNull(), F.struct(time, order))).alias("_timed"),
        F.max_by(timed, F.when(F.col(time).isNull(), F.col(order))).alias("_untimed"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in open_],
        F.max(time).alias(time),
    )
    later = F.col("_timed").isNull() | F.coalesce(F.col("_untimed.n") > F.col("_timed.n"), F.lit(False))
    last = F.when(later, F.col("_untimed.v")).otherwise(F.col("_timed.v"))
    return state.withColumn("_v", last).select(key, *[F.col("_v")[c].alias(c) for c in guarded], *open_, time)


def failure_throttle(
    events: DataFrame, key: str, time: str, failed: str, most: int = USER_FAILURES, minutes: int = THROTTLE_MINUTES, span: int = 96
) -> DataFrame:
    """Every event with the failures of its key in the last minutes before it, and whether it is locked out.

    All failures count, so a range frame is right; the event itself isn't counted. A key's events are dealt by time: a group holds
    ``span`` times the minutes, and the failures of the minutes before it once more.
    """
    width = minutes * 60_000_000
    at = events.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    group = lambda c: F.floor(c / (span * width))
    own = F.struct(group(F.col("_at")).alias("_group"), F.lit(True).alias("_own"))
    next_ = F.struct(group(F.col("_at") + width).alias("_group"), F.lit(False).alias("_own"))
    again = F.coalesce(F.col(failed), F.lit(False)) & (group(F.col("_at") + width) > group(F.col("_at")))
    dealt = at.select("*", F.inline(F.when(again, F.array(own, next_)).otherwise(F.array(own))))
    back = Window.partitionBy(key, "_group").orderBy("_at").rangeBetween(-width, -1)
    n = F.coalesce(F.sum(F.col(failed).cast("int")).over(back), F.lit(0))
    counted = dealt.withColumn("failures", n).filter("_own")
    return counted.withColumn("locked", F.col("failures") >= most).drop("_at", "_group", "_own")


def sliding_limit(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """(key, tie, allowed): admit an event while fewer than ``limit`` admitted ones lie in the window before it.

    Denied events leave no trace, so each decision depends on those before it. Keys are dealt over tasks and sorted by arrival; a task runs through
    its rows in Arrow batches and keeps at most ``limit`` times of the key it is at, however many events that key has.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    slim = events.select(key, tie, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    width = int(seconds * 1_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[int] = deque()
        now: object = held  # no key yet
        for b in batches:
            out = []
            for k, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != now:
                    now = k
                    held.clear()
                while held and held[0] < at - width:  # an event just as old as the window still counts
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], [key, tie, "allowed"])

    placed = slim.repartition(key).sortWithinPartitions(key, "_at", tie)
    return placed.mapInArrow(fold, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean")


def usage_by_month(events: DataFrame, key: str, time: str, amount: str | None = None) -> DataFrame:
    """Counter rows by (key, YYYYMM)."""
    n = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return events.groupBy(key, period_key(F.col(time)).alias("period")).agg(n.alias("used"))


def add_counters(old: DataFrame, new: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Additive upsert."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(amount).alias(amount))


def tumbling(events: DataFrame, time: str, width: str, value: str, *keys: str) -> DataFrame:
    w = F.window(time, width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, width: str, slide: str, *keys: str) -> DataFrame:
    w = F.window(time, width, slide)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    w = F.session_window(time, gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), "n")
