"""Each stage of the pipeline against a plain version on that stage's own input."""

from __future__ import annotations

import os
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import common, queries, substring, tokens, toxicity
from codeloom.llm.common import cut

from .test_brute_force import FOLDER, plain_removal
from .test_near_copies import plain_kept

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, over the documents with a further column and rows with nulls."""
    if not os.path.isdir(FOLDER):
        pytest.skip("the test tables are not here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("row", F.lit("kept")).withColumn("a.b", F.col("doc_id"))
    odd = docs.limit(1)
    docs = docs.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.withColumn("doc_id", F.lit(900_001).cast("long")).withColumn("text", F.lit(None).cast("string")))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, FOLDER), "stage-test")
        if name != NAMES[-1]:
            assert after.columns == docs.columns
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_stage_order():
    assert NAMES == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scorer = toxicity.fit(frame.select(F.col("doc_id").alias("id"), "text"), spark.read.parquet(f"{FOLDER}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    want = {(r.doc_id, r.text) for r, s in zip(before, scorer.score([r.text for r in before])) if s < 0.5}
    assert {(r.doc_id, r.text) for r in after} == want


def test_one_of_each_group_stays(stages):
    """Links are Jaccard similarities of 0.8 of five-word shingles, found here by comparing all pairs."""
    before, after = stages["near_dedup"]
    rows = sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id)
    kept = plain_kept([r.text for r in rows])
    assert len(kept) < len(rows) and {r.doc_id for r in after if r.doc_id is not None} == {rows[i].doc_id for i in kept}
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)


def test_repeated_passages_go(stages):
    before, after = stages["substring_dedup"]
    last = 2**62
    want = plain_removal([(last if r.doc_id is None else r.doc_id, r.text) for r in before], 50)
    texts = {last if r.doc_id is None else r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        i = last if r.doc_id is None else r.doc_id
        n, gone, kept = want[i]
        assert r.text == (kept if gone else texts[i])
        if gone:
            assert r.n_chars == len(kept)


def test_leaks_go_and_clean_documents_stay(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    leaks = {(r.doc_id, r.text) for r in before if any(flat(i) in flat(r.text) for i in items)}
    gone = {(r.doc_id, r.text) for r in before} - {(r.doc_id, r.text) for r in after}
    assert leaks and leaks <= gone
    grams = lambda t: {" ".join(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)}
    for _, text in gone - leaks:  # a long part of an item
        assert any(grams(flat(text)) & grams(flat(i)) for i in items)


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    ids = sorted({r.doc_id for r in before if r.doc_id is not None})
    assert sorted({r.doc_id for r in after if r.doc_id is not None}) == ids
    fill: dict[int, int] = {}
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.05 * sum(fill.values()) / 1024 + 1


def test_nothing_gives_nothing(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("the test tables are not here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER), "empty-test")
        assert docs.count() == 0, name


def test_a_bucket_holds_little_more_than_its_windows():
    """Words and texts are split one document at a time, so a bucket's memory is that of its windows' hashes."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=200)) for _ in range(1000)]
    t = pa.table({"bucket": [0] * len(texts), "id": list(range(len(texts))), "text": texts})
    substring.Bucket(t, 50)  # tables of powers stay
    tracemalloc.start()
    b = substring.Bucket(t, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(b.place)


def test_tasks_that_do_not_encode_free_the_tokenizer():
    encode = common.tidy(lambda batches: (tokens.encode_documents(queries.tokenizer(), ["a b"], 2) for _ in batches), keep_encoder=True)
    other = common.tidy(lambda batches: batches)
    assert len(list(encode(iter([0])))) == 1 and tokens.encoder.cache_info().currsize
    list(encode(iter([])))
    assert tokens.encoder.cache_info().currsize
    list(other(iter([0])))
    assert not tokens.encoder.cache_info().currsize
