"""A vendor's webhooks as a stream: verify, record, apply, mark, with a ledger that survives a batch cut off at any point.

Every attempt is recorded before anything is applied. An event is marked when its effect is stored; one that is
recorded but not marked is applied again by the next batch that brings it, which changes nothing where it was applied
already, since an event only moves a subscription to what the event says. Ledger and subscriptions are snapshot tables, so
a batch that dies while it writes one leaves that table as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.sinks import SnapshotTable, write_graph
from .events import late_guard

LEDGER = "vendor string, event_id string, valid boolean, received timestamp, processed_batch long"
SUBSCRIPTIONS = "subscription string, status string, event_at timestamp"
#: Fixed value: seconds that a signed time may lie away from the time of receipt.
TOLERANCE = 300


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a string or binary column, by Spark's own SHA-2."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256)


def verified(deliveries: DataFrame, secret: bytes, tolerance: int = TOLERANCE) -> DataFrame:
    """``deliveries`` with ``valid``: the signature is that of ``id.time.body`` and the signed time is near the time of receipt.

    Columns: event_id, signed_at (seconds, a string), received, body, signature (hex, of "v1,..." entries parted by spaces).
    """
    want = F.concat(F.lit("v1,"), hmac_sha256(secret, F.concat_ws(".", "event_id", "signed_at", "body")))
    near = F.abs(F.unix_timestamp("received") - F.expr("try_cast(signed_at AS BIGINT)")) <= tolerance
    return deliveries.withColumn("valid", F.coalesce(near & F.array_contains(F.split("signature", " "), want), F.lit(False)))


def parsed(deliveries: DataFrame) -> DataFrame:
    """The envelope's fields: subscription, status and event_at; null where the body has none."""
    body = F.from_json("body", "subscription string, status string, event_at timestamp")
    return deliveries.withColumn("_b", body).select("*", "_b.subscription", "_b.status", "_b.event_at").drop("_b")


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row an event: of its deliveries a valid one before others, then the first received."""
    rest = [c for c in events.columns if c not in ("vendor", "event_id")]
    order = F.struct((~F.col("valid")).alias("_bad"), "received", F.col("body"))
    return events.groupBy("vendor", "event_id").agg(F.min_by(F.struct(*rest), order).alias("e")).select("vendor", "event_id", "e.*")


def process(batch: DataFrame, number: int, ledger: SnapshotTable, subscriptions: SnapshotTable, secret: bytes, cut_off: Callable[[str], None] = lambda step: None) -> None:
    """One batch of deliveries. ``cut_off`` is called after each step that is stored (record, apply, mark); tests raise in it."""
    seen = verified(batch, secret).persist()  # used by three writes; lost blocks are computed again
    try:
        events = first_arrivals(parsed(seen))
        keys = ["vendor", "event_id"]
        row = events.select(*keys, "valid", "received", F.lit(None).cast("long").alias("processed_batch"))
        # a valid delivery after a forged one makes the event valid; the first valid receipt stays
        write_graph(ledger, row, keys, or_cols=["valid"])
        cut_off("record")
        open_ = ledger.read().filter("processed_batch is null and valid").select(*keys)
        due = events.filter("valid").join(open_, keys, "left_semi")
        moves = due.filter("subscription is not null and status is not null").select("subscription", "status", "event_at", "received", "event_id")
        stored = subscriptions.read().join(moves.select("subscription").distinct(), "subscription", "left_semi")
        stored = stored.select(*stored.columns, F.lit(None).cast("timestamp").alias("received"), F.lit(None).cast("string").alias("event_id"))
        arrival = F.struct(F.col("received").isNotNull().alias("new"), "received", "event_id")
        after = late_guard(stored.unionByName(moves).withColumn("_arrival", arrival), "subscription", "event_at", "_arrival", ["status"])
        subscriptions.rewrite(after, lambda old, new: old.join(new, "subscription", "left_anti").unionByName(new))
        cut_off("apply")
        write_graph(ledger, due.select(*keys, "valid", "received", F.lit(number).cast("long").alias("processed_batch")), keys, or_cols=["valid"])
        cut_off("mark")
    finally:
        seen.unpersist()


def webhook_stream(deliveries: DataFrame, ledger: SnapshotTable, subscriptions: SnapshotTable, secret: bytes, checkpoint: str, cut_off: Callable[[str], None] = lambda step: None) -> StreamingQuery:
    """Run ``process`` on what has arrived. The stream's checkpoint repeats a batch that did not end; the ledger makes that harmless."""
    writer = deliveries.writeStream.foreachBatch(lambda df, n: process(df, n, ledger, subscriptions, secret, cut_off))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
