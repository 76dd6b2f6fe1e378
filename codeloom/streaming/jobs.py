"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .events import usage_by_month


def read_events(spark, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A file stream; new files are new events."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def intake_stream(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each event once; a key is remembered as long as the watermark lets its replays come."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts of tumbling windows, given out when the watermark has passed."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n")


def late_guard_stream(events: DataFrame, key: str, time: str, order: str, value: str) -> DataFrame:
    """After each batch, the guarded value and time of every key that it touched.

    ``value`` is a string column. State per key: the last applied value and the greatest time.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, top = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for at, v in zip(rows["_at"], rows[value]):
            known = not pd.isna(at)
            if not known or top is None or at >= top:
                kept = v
            if known and (top is None or at > top):
                top = int(at)
        state.update((kept, top))
        yield pd.DataFrame({key: [k[0]], value: [kept], "event_micros": pd.array([top], dtype="Int64")})

    kind = events.schema[key].dataType.simpleString()
    slim = events.select(key, order, value, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    return slim.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {value} string, event_micros long", f"{value} string, event_micros long",
        "update", "NoTimeout")


def count_usage(events: DataFrame, key: str, time: str, add: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch's counters by (key, YYYYMM) to ``add``, with the batch's number, so that a replay can be told."""
    return events.writeStream.foreachBatch(lambda df, epoch: add(usage_by_month(df, key, time), epoch)).start()
