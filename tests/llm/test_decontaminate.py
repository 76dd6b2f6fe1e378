"""Benchmark items that are rich in values, or copied with small changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, near_copies, simhash

ITEMS = [
    (1, "What is 12 + 30 - 7 + 45 * 3 / 9 - 2?"),
    (2, "Find the sum of 3, 5, 7, 9, 11, 13, 15, 17, 19 and 21."),
    (3, "one bright morning every quiet farmer walked slowly over green hills toward that distant river crossing"),
    (4, "31 41 59 26 53 58 97 93 23 84"),
]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}


def test_items_rich_in_values(spark):
    around = "some noise before. {} And noise after"
    texts = [around.format(t) for _, t in ITEMS]
    texts += ["so what is 5 + 6 - 8 + 13 * 2 / 4 - 1? yes", "row 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17", "find the sum of 3 and 5"]
    assert found(spark, texts) == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 1)}


@pytest.mark.parametrize("at", [7, 8, 15])
def test_one_word_changed(spark, at):
    words = ITEMS[2][1].split()
    assert len(words) == 16
    words[at] = "zzz"
    assert found(spark, [" ".join(words)]) == {(0, 3)}


def test_values_of_other_length(spark):
    """A value of other length than the item's takes one place all the same."""
    items = [(1, "every red train on the old northern line needs 60 minutes for its daily trip past seven villages"), (2, "we asked why the old clerk in Paris had sent those seven letters away")]
    first, second = (t for _, t in items)
    values = ["75", "1,250", "62.50", "-3", "1.250,75"]
    names = ["London", "New York", "Rio Grande City"]
    texts = [f"noise {first.replace('60', v)} noise" for v in values] + [f"noise {second.replace('Paris', n)} noise" for n in names]
    assert found(spark, texts, items) == {(i, 1) for i in range(5)} | {(i, 2) for i in range(5, 8)}
    twice = [(1, "take 60 from the box and 60 from that bag so that both hold just the same now")]
    other = "take {} from the box and {} from that bag so that both hold just the same now"
    assert found(spark, [other.format("1,250", "1,250"), other.format("1,250", "1.250"), other.format("5", "-5")], twice) == {(0, 1)}


def test_both_kinds_of_tokens_are_aligned(spark):
    texts = ["in New York City-7 and McDonald Smith 5-3 of -4 km, a-5 v1.2.3 £1,250.75 then 3.", "said Bob\nAnswer 5 kg-7 \ue000 1\ue0002 §Bob-5 § -5 ¤-3 so,1,2 X Y", "go Éa Bc D Ef Gh-Ij 1. 2 ,3 −4"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in d.select(decontaminate.template_tokens(F.col("text")).alias("t"), F.transform(decontaminate.slot_tokens(F.col("text")), decontaminate.canonical).alias("s")).collect():
        assert len(r.t) == len(r.s), (r.t, r.s)


def test_first_words_that_are_names(spark):
    items = [(1, "Alice buys 3 pens and 4 books for Bob at the shop")]
    texts = ["Maria buys 5 pens and 6 books for Tom at the shop", "he said: Maria buys 5 pens and 6 books for Tom at the shop.", "so, then Maria buys 5 pens and 6 books for Tom at the shop", "Maria buys 5 pens and 6 books for Tom and Maria"]
    assert found(spark, texts, items) == {(0, 1), (1, 1), (2, 1)}


def test_numbers_in_words(spark):
    items = [(1, "the basket has two apples and the fleet has twelve engines and seven wings in all of it")]
    texts = [f"noise the basket has {a} apples and the fleet has {b} engines and {c} wings in all of it noise" for a, b, c in (("three", "twenty", "nine"), ("3", "20", "9"), ("two", "two", "seven"), ("acht", "doce", "cent"))]
    assert found(spark, texts, items) == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_a_run_of_values_needs_words_beside_it(spark):
    items = [(1, "compute 1 2 3 4 5 6 7"), (2, "Compute 1 2 3 4 5 6 7 now or not, by hand")]
    assert found(spark, ["they compute 9 8 7 6 5 4 3 now", "they compute 1 2 3 4 5 6 7 now", "please compute 9 8 7 6 5 4 3 now or not, by hand"], items) == {(1, 1), (2, 2)}


def test_shuffled_plan_gives_the_same_rows(spark, monkeypatch):
    """With no room for broadcasts, windows and places meet by shuffle."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    left = sorted(r.doc_id for r in decontaminate.keep_unseen(docs, bench).select("doc_id").collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_PLACES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want and want
        assert sorted(r.doc_id for r in decontaminate.keep_unseen(docs, bench).select("doc_id").collect()) == left
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_clashing_names(spark):
    """Columns named as the stages' own don't stop them."""
    rows = [(1, "every quiet farmer walked slowly over green hills toward that distant river crossing", "a", 1, 2, "x"), (2, "other words", "b", 3, 4, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _body int, _gone0 int, row_key string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in decontaminate.keep_unseen(d, bench).collect()] == [rows[1]]
    twice = d.union(d.withColumn("doc_id", d.doc_id + 10))
    for keep in (simhash.keep_first, near_copies.keep_first):
        got = keep(twice)
        assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_very_long_runs(spark):
    """A run of thousands of names or of a number's groups is one token; a greedy pattern overflows the stack and ends the session's JVM."""
    names, groups = "so " + " ".join(["Aa Bbb"] * 10_000), "so " + ",".join(["1", "22"] * 10_000)
    docs = spark.createDataFrame([(1, f"{names}. {ITEMS[2][1]}"), (2, f"{groups} {ITEMS[2][1]}"), (3, names)], "doc_id long, text string")
    sizes = docs.orderBy("doc_id").select(F.size(decontaminate.template_tokens(F.col("text"))).alias("n"), F.size(F.transform(
        decontaminate.slot_tokens(F.col("text"), True), decontaminate.canonical)).alias("m")).collect()
    assert [(r.n, r.m) for r in sizes] == [(18, 18), (18, 18), (2, 2)]
    assert {r.doc_id for r in decontaminate.keep_unseen(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()} == {3}
