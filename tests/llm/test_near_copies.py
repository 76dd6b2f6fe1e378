"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import near_copies


def plain_set(text, k=5):
    words = (text or "").lower().split()
    k = min(k, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_kept(texts):
    """Places of the least member of each group that links of all pairs connect."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(sets)) if find(i) == i}


@pytest.fixture(scope="module")
def texts():
    """Originals with copies of 1 to 12 changed words, a chain, a large group, short and empty texts."""
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", "one two", "one two three", "ONE  two"]
    for _ in range(25):
        base = random.choices(words, k=random.randint(60, 300))
        out.append(" ".join(base))
        for n in (1, 3, 6, 12):
            copy = list(base)
            for at in random.sample(range(len(copy)), n):
                copy[at] = random.choice(words)
            out.append(" ".join(copy))
    long = random.choices(words, k=400)
    out += [" ".join(long[i * 15 : i * 15 + 200]) for i in range(10)]
    hub = random.choices(words, k=150)
    out += [" ".join([*hub, f"end{i}"]) for i in range(60)]
    return out


def test_stage_is_brute_force_jaccard(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()}
    assert got == plain_kept(texts)


def test_large_cells_are_dealt_out(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_copies.components_of(d, most=2000).collect()
    assert {r.id for r in rows if r.id == r.component_id} == plain_kept(texts)


def test_an_id_with_several_texts_loses_no_group(spark):
    a, b = ("red green blue one two three " * 3).strip(), "other words that stand alone in this table here"
    d = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a), (None, a)], "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()}
    assert left == {(5, a), (3, b), (None, a)}
    assert corpus_pipeline.drop_near_copies(spark, d.limit(0), "").count() == 0


def test_search_joins_chains():
    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in (0, 3, 6, 9, 100)]
    assert sorted(near_copies.search(np.array([4, 3, 2, 1, 0]), sets)) == [(2, 1), (3, 1), (4, 1)]
