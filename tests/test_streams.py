"""Streaming forms against their batch forms, over files that arrive in several batches."""

from __future__ import annotations

import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest

from codeloom.operators.sinks import SnapshotTable
from codeloom.streaming import events, jobs, limits, webhooks

KIND = "event_id int, user string, at timestamp, n int, status string"
START = datetime(2024, 1, 1)
ROWS = [(i % 9, f"u{i % 3}", START + timedelta(minutes=(i * 37) % 600), i, f"s{i}") for i in range(40)]


def stream(spark, tmp_path, batches=4):
    for k in range(batches):
        spark.createDataFrame(ROWS[k::batches], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return jobs.read_events(spark, f"{tmp_path}/in", KIND, 1)


def run(df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_each_event_once(spark, tmp_path):
    got = run(jobs.intake_stream(stream(spark, tmp_path), ["event_id", "user"], "at", "2 days"), "intake", "append", tmp_path)
    assert sorted((r.event_id, r.user) for r in got.collect()) == sorted({(r[0], r[1]) for r in ROWS})


def test_windows_close_behind_the_watermark(spark, tmp_path):
    got = run(jobs.windowed_counts(stream(spark, tmp_path), "at", "1 hour", "1 day", "user"), "windows", "update", tmp_path)
    last: dict = {}
    for r in got.collect():
        last[r.window_start, r.user] = max(r.n, last.get((r.window_start, r.user), 0))
    want: dict = {}
    for _, user, at, _, _ in ROWS:
        key = (at.replace(minute=0), user)
        want[key] = want.get(key, 0) + 1
    assert last == want


def test_late_events_change_nothing(spark, tmp_path):
    spark.createDataFrame(ROWS, KIND).coalesce(1).write.parquet(f"{tmp_path}/in")
    whole = jobs.late_guard_stream(jobs.read_events(spark, f"{tmp_path}/in", KIND), "user", "at", "n", "status")
    got = {r.user: r.status for r in run(whole, "guard", "update", tmp_path).collect()}
    batch = {r.user: r.status for r in events.late_guard(spark.createDataFrame(ROWS, KIND), "user", "at", "n", ["status"]).collect()}
    assert got == batch


def test_counters_add_up(spark, tmp_path):
    total: dict = {}

    def add(counted, epoch):
        for r in counted.collect():
            total[r.user, r.period] = total.get((r.user, r.period), 0) + r.used

    jobs.count_usage(stream(spark, tmp_path), "user", "at", add).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    want: dict = {}
    for _, user, at, _, _ in ROWS:
        want[user, f"{at:%Y%m}"] = want.get((user, f"{at:%Y%m}"), 0) + 1
    assert total == want


def test_sliding_and_sessions(spark):
    d = spark.createDataFrame([("u", START + timedelta(minutes=m)) for m in (0, 10, 50, 200)], "user string, at timestamp")
    assert sorted((r.window_start.hour * 60 + r.window_start.minute, r.n) for r in events.sliding(d, "at", "1 hour", "30 minutes", "user").collect() if r.window_start >= START) == [(0, 3), (30, 1), (150, 1), (180, 1)]
    assert sorted(r.n for r in events.sessions(d, "user", "at", "45 minutes").collect()) == [1, 3]
    old = spark.createDataFrame([("u", "202401", 2)], "user string, period string, used long")
    assert events.add_counters(old, spark.createDataFrame([("u", "202401", 3), ("v", "202401", 1)], old.schema), ["user", "period"], "used").count() == 2


def test_the_limit_as_a_stream(spark, tmp_path):
    """Batches in order of time: the decisions are those of the batch operator, and state holds admitted times alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ordered = sorted(ROWS, key=lambda r: (r[2], r[3]))
        for k in range(4):
            spark.createDataFrame(ordered[k * 10 : k * 10 + 10], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = jobs.read_events(spark, f"{tmp_path}/in", KIND, 1)
        got = run(limits.sliding_limit_stream(source, "user", "at", "n", 1, 3600, "1 day"), "limit", "append", tmp_path)
        want = events.sliding_limit(spark.createDataFrame(ROWS, KIND), "user", "at", "n", 1, 3600)
        assert {r.allowed for r in want.collect()} == {True, False}
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_timer_drops_idle_keys(spark, tmp_path):
    """A key whose window the watermark has passed starts anew; the timer, not an event of the key, drops its times."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        times = [("a", 0), ("a", 1), ("b", 500), ("b", 501), ("a", 502)]
        for i, (user, m) in enumerate(times):
            spark.createDataFrame([(i, user, START + timedelta(minutes=m), i, "s")], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(limits.sliding_limit_stream(jobs.read_events(spark, f"{tmp_path}/in", KIND, 1), "user", "at", "n", 1, 60 * 60, "1 minute"), "timer", "append", tmp_path)
        assert sorted((r.n, r.allowed) for r in got.collect()) == [(0, True), (1, False), (2, True), (3, False), (4, True)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# webhooks

SECRET = b"s" * 70
DELIVERY = "vendor string, event_id string, signed_at string, received timestamp, body string, signature string"


def delivery(i, sub, status, day, minute, forged=False, vendor="x", skew=0):
    at = START + timedelta(days=9, minutes=minute)
    signed = str(int(at.timestamp()) + skew)
    body = json.dumps({"subscription": sub, "status": status, "event_at": None if day is None else (START + timedelta(days=day)).isoformat()})
    good = hmac.new(SECRET, f"{i}.{signed}.{body}".encode(), hashlib.sha256).hexdigest()
    return (vendor, i, signed, at, body, "v0,zz v1," + ("0" * 64 if forged else good))


DELIVERIES = [
    [delivery("e1", "s1", "active", 3, 0), delivery("e2", "s1", "stale", 2, 1), delivery("e3", "s2", "trial", 1, 2), delivery("bad", "s2", "stolen", 8, 3, forged=True)],
    [delivery("e1", "s1", "active", 3, 4), delivery("e4", "s2", "paid", 4, 5), delivery("old", "s2", "late", 9, 6, skew=-900), delivery("e5", "s3", "untimed", None, 7)],
    [delivery("bad", "s2", "real", 5, 8), delivery("e6", "s1", "gone", 3, 9), delivery("e4", "s2", "paid", 4, 10)],
]
WANT = {"s1": "gone", "s2": "real", "s3": "untimed"}


def tables(spark, tmp_path):
    return (SnapshotTable(spark, f"file://{tmp_path}/ledger", webhooks.LEDGER, ["vendor", "event_id"], 4), SnapshotTable(spark, f"file://{tmp_path}/subs", webhooks.SUBSCRIPTIONS, ["subscription"], 4))


@pytest.mark.parametrize("step", [None, "record", "apply", "mark"])
def test_webhooks_survive_a_batch_that_is_cut_off(spark, tmp_path, step):
    ledger, subs = tables(spark, tmp_path)
    broken = []

    def cut_off(at):
        if at == step and len(broken) < 1:
            broken.append(at)
            raise RuntimeError("executor of the driver's patience lost")

    for batch in DELIVERIES:
        spark.createDataFrame(batch, DELIVERY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second start takes up a batch that did not end
            source = jobs.read_events(spark, f"{tmp_path}/in", DELIVERY)
            try:
                webhooks.webhook_stream(source, ledger, subs, SECRET, f"{tmp_path}/checkpoint", cut_off).awaitTermination()
            except Exception as e:
                assert "patience" in str(e)
    assert len(broken) == (step is not None)
    assert {r.subscription: r.status for r in subs.read().collect()} == WANT
    log = {r.event_id: r for r in ledger.read().collect()}
    assert set(log) == {"e1", "e2", "e3", "e4", "e5", "e6", "bad", "old"} and not log["old"].valid
    assert {i for i, r in log.items() if r.processed_batch is not None} == set(log) - {"old"}
    assert log["e1"].processed_batch == 0 and log["e4"].processed_batch == 1


def test_signatures(spark):
    from pyspark.sql import functions as F
    for key in (b"k", b"q" * 64, b"z" * 65):
        d = spark.createDataFrame([("",), ("naïve 😀",), ("x" * 500,)], "m string").select("m", webhooks.hmac_sha256(key, F.col("m")).alias("h"))
        assert all(r.h == hmac.new(key, r.m.encode(), hashlib.sha256).hexdigest() for r in d.collect())
    odd = [("v", None, None, None, None, None), ("v", "e", "soon", START, "{", "v1,")]
    assert [r.valid for r in webhooks.verified(spark.createDataFrame(odd, DELIVERY), SECRET).collect()] == [False, False]
