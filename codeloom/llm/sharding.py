"""Jump consistent hashing: a key and the shard count alone decide the shard.

When one shard is added, a row stays or moves into the new shard; no ring table is kept. A row's slot is its
place among its shard's rows by key, from written range partitions, so a shard's rows never meet in one task.

Cases: a null key hashes like any other value (all null keys share a shard); a null text has no bytes; rows
that repeat a key share its shard and take different slots; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets in 0..n-1 of unsigned 64-bit keys, for all keys at once.

    Each key steps through ever later bucket numbers, driven by a linear congruential generator, and keeps
    the last one below ``n``.
    """
    if n < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    ahead = np.zeros(len(state), np.int64)
    while len(live):
        bucket[live] = ahead
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        drawn = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead = np.floor((bucket[live] + 1) * (2147483648.0 / drawn)).astype(np.int64)
        inside = ahead < n
        live, ahead = live[inside], ahead[inside]
    return bucket


def jump_shard(key: Column, n: int) -> Column:
    """The shard, in 0..n-1, of a 64-bit hash."""

    @F.pandas_udf("int")
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(jump_hash(b.to_numpy(np.int64).view(np.uint64), n).astype(np.int32))

    return shard(key)


def shard_rows(df: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc key, size, text_crc32, law, shard, slot and the shard it would take with one shard more."""
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    slim = df.select(F.col(key_col).alias("_key"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    hashed = slim.withColumn("_hash", F.xxhash64("_key"))
    placed = hashed.select("_key", "size", "text_crc32", jump_shard(F.col("_hash"), shards).alias("shard"),
        jump_shard(F.col("_hash"), shards + 1).alias("grown_shard"))
    slots = running(placed, ["_key", "text_crc32", "size"], ["shard"], label="shards")
    return slots.select(F.col("_key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard")
