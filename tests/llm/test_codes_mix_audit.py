"""Vector codes, source mixing and the source audit against plain loops, with nulls, empties, ties and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import divergence, mixing, quantize, queries

FOLDER = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int, id string, ids int, code int, _label int"


# 11


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, 2, 3) for i, v, label in rows], VEC)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds in Python integers."""
    kept = [(i, [math.floor(4096 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (far(cut(r[1], p), books[p][e]), e)) for p in range(parts)] for r in kept]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, c in zip(kept, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = nearest()
    error = [sum(far(cut(r[1], p), books[p][c[p]]) for p in range(parts)) for r, c in zip(kept, codes)]
    label = defaultdict(int)
    for r, e in zip(kept, error):
        label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{x:02x}" for x in c), e, label[r[2]], sha) for r, c, e in zip(kept, codes, error))


def coded(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def drawn(n, seed, spread=3.0, width=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, spread, (7, width))
    return [(int(i), [*(middles[rng.integers(7)] + rng.normal(0, 0.3, width))], None if i % 11 == 0 else int(i % 3)) for i in rng.permutation(n)]


def test_codes_equal_plain_lloyd(spark):
    rows = drawn(400, 1)
    odd = [(None, [0.5] * 16, 1), (5000, None, 1), (5001, [1.0] * 15 + [None], 2), (5002, [float("nan")] * 16, 2), (5003, [float("-inf")] + [0.0] * 15, 2)]
    ties = [(6000 + i, [0.25 * (i % 3)] * 16, None) for i in range(60)] + [rows[0]] * 3
    every = rows + odd + ties
    assert coded(quantize.compress(vectors(spark, every).repartition(3))) == plain_codes(every)


@pytest.mark.parametrize("n", [1, 5, 16, 17])
def test_few_vectors_make_few_entries(spark, n):
    rows = drawn(n, 2)
    assert coded(quantize.compress(vectors(spark, rows))) == plain_codes(rows)


def test_table_of_embeddings_equals_plain_lloyd(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert coded(queries.op11_heap_lloyd(spark, FOLDER)) == plain_codes(rows)


def test_heaps_spare_most_rescans_and_blocks_do_not_matter(spark):
    rows = drawn(3000, 3, spread=8.0)
    df = vectors(spark, rows).repartition(2)
    state, books, popped = quantize.fit(df, block=500)
    whole, same, _ = quantize.fit(df, block=1 << 20)
    assert (books == same).all() and popped[0] == 3000 * 8
    assert sum(popped[1:]) < 0.6 * 6 * 3000 * 8  # bounds decide the rest
    assert state.count() >= 6


def test_heap_pops_are_those_that_drift_has_reached():
    rng = np.random.default_rng(4)
    code, key = rng.integers(0, 5, 300).astype(np.uint8), rng.normal(0, 1, 300).astype(np.float32)
    heap = quantize.Heaps.of(code, key)
    drift = np.array([-9.0, 0.0, 0.5, 9.0, -0.25])
    out = heap.pop(drift)
    assert sorted(out) == [i for i in range(300) if key[i] <= drift[code[i]]]
    heap.push(code[out], key[out], out)
    assert sorted(heap.member) == list(range(300)) and all(heap.key[i] <= heap.key[i + 1] for i in range(299) if heap.code[i] == heap.code[i + 1])


def test_kept_bounds_never_hide_a_nearer_entry():
    """Drift that comes in many small steps: what stays in a heap keeps its entry, ties included."""
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (500, 2))
    books = rng.integers(-40, 40, (1, 9, 2)).astype(np.int64)
    drift = np.zeros((1, 9))
    code, key = quantize.rescan(x, books[0], drift[0])
    heap, codes = quantize.Heaps.of(code, quantize.to_float32_below(key)), code.copy()
    for _ in range(30):
        new = books + rng.integers(-2, 3, books.shape)
        drift = drift + quantize.moved_by(books, new)
        books = new
        out = heap.pop(drift[0])
        codes[out], key = quantize.rescan(x[out], books[0], drift[0])
        heap.push(codes[out], quantize.to_float32_below(key), out)
        assert (codes == quantize.distances(x, books[0]).argmin(1)).all()


def test_codes_of_odd_tables(spark):
    assert quantize.compress(vectors(spark, [])).collect() == []
    assert quantize.compress(vectors(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError):
        quantize.compress(vectors(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(Exception, match="differ in length"):
        quantize.compress(vectors(spark, [(i, [1.0] * (16 if i < 20 else 8), 1) for i in range(21)])).collect()
    with pytest.raises(ValueError, match="2\\^27"):
        quantize.compress(vectors(spark, [(1, [1e9] * 8, 1)]))


# 12


DOC = "doc_id long, text string, lang string, source string, size int, e int, w int, place int, target int, before int, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 2, 3, 4, 5, 6, "r") for i, t, lang, s in rows], DOC)


def plain_targets(sizes: dict, weights=(5, 2, 1), repeats=3):
    """The excess is shared anew until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: Fraction(rest * w[s], sum(w[f] for f in free)) for s in free}
        above = [s for s in free if share[s] > repeats * sizes[s]]
        if not above:
            return share | fixed
        fixed |= {s: Fraction(repeats * sizes[s]) for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_reshared_excess(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice([f"s{i}", f"é{i}", f"Z{i}"]): rng.choice([0, 1, 3, 50, 1000, 10**9]) for i in range(9)} | {None: rng.randint(0, 90), "": 7}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: (r.target, r.quota) for r in mixing.targets(mixing.source_sizes(rows)).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    for s, t in want.items():
        assert math.isclose(got[s][0], float(t), rel_tol=1e-12) and got[s][1] == math.floor(t)


def test_mix_takes_each_target_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), "en", rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(300)]
    rows += [(7, None, "en", "a"), (None, "no id", "en", "b"), (None, "no id", "en", "b"), (900, "long " * 30_000, "en", "a"), (901, " \t\n", None, "d"), rows[0], rows[0]]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _, _ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = plain_targets(sizes)
    taken, whole = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.target] += r.taken
        whole[r.target] = r.source_size
    assert {(math.floor(t), sizes[s]) for s, t in want.items()} == {(n, whole[t]) for t, n in taken.items()}
    again = mixing.mix(df.repartition(7).orderBy(F.rand(1))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_order_follows_the_schedules(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(4000)]
    flat, late = ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.5, 0.0), (1.0, 4.0))
    order = mixing.curriculum(docs(spark, rows), weights=(1, 1), schedules=(flat, late)).orderBy("start").collect()
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_words
    assert [r.position for r in order] == sorted(r.position for r in order)
    for r in order:
        share = (r.epoch * r.source_size + r.source_rank * 10 + 5) / 20_000  # equal sizes: the rank gives the words before
        want = share if r.source_place == 0 else 0.5 + 0.5 * math.sqrt(share)
        assert math.isclose(r.position, want, abs_tol=1e-9)
    assert sum(r.source_place for r in order if r.position < 0.5) == 0


def test_inverse_of_the_integrated_schedule(spark):
    knots = ((0.0, 1.5), (0.25, 0.0), (0.5, 2.0), (1.0, 0.5))
    shares = spark.createDataFrame([(i / 200,) for i in range(201)], "share double")
    for r in shares.select("share", mixing.when_demanded(F.col("share"), knots).alias("t")).collect():
        area = lambda t: sum(max(0, min(t, b[0]) - a[0]) * (a[1] + (a[1] + (b[1] - a[1]) * (min(max(t, a[0]), b[0]) - a[0]) / (b[0] - a[0]))) / 2 for a, b in zip(knots, knots[1:]))
        assert math.isclose(area(r.t), r.share * area(1.0), abs_tol=1e-9)
    with pytest.raises(ValueError):
        mixing.when_demanded(F.col("share"), ((0.0, 0.0), (1.0, 0.0)))


def test_mix_of_odd_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    got = mixing.mix(docs(spark, [(1, None, None, None), (2, "", None, "x")])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken, r.first_start) for r in got) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]


# 13


def plain_audit(rows, min_docs=30, top=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    docs_of, count, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for k, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in term.findall((text or "").translate(fold)):
            docs_of[lang, t].add(k)
            count[lang, source][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for (g, t), d in docs_of.items() if g == lang and len(d) >= min_docs), key=str.encode)
        share = lambda n, whole: 1 + 10**9 * (n + 5) // (whole + 5 * len(kept))
        total = Counter()
        for s in sources:
            total.update({t: count[lang, s][t] for t in kept})
        q = {t: share(total[t], sum(total[x] for x in kept)) for t in kept}
        p = {s: {t: share(count[lang, s][t], sum(count[lang, s][x] for x in kept)) for t in kept} for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def audit(df, **more):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in divergence.divergence(df, **more).collect())


def texts(seed, n=260):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "Ünit", "ünit", "😀x", "a1b", "don't", "x_y", "文字", *(f"{a}{b}" for a in "pqr" for b in "stuvw")]
    odd = [(None, None, None, None), (1, "", "en", "empty"), (2, "12 34 !?", "xx", None), (3, None, "xx", "s"), (4, "the " * 50_000, "en", "s1"), (4, "the", "en", "s1")]
    return odd + [(i, " ".join(rng.choices(words, k=rng.randint(0, 25))), rng.choice(["en", "en", "de", None]), rng.choice(["s1"] * 5 + ["s2", "s3", "é", None])) for i in range(n)]


def test_audit_equals_plain_counts(spark):
    rows = texts(1)
    want = plain_audit(rows)
    assert len(want) > 60 and {r[2] for r in want} == {"pair", "term"}
    df = docs(spark, rows)
    assert audit(df) == want
    # small blocks and batches, sources in blocks of two, shards of a few rows, few salts: the same rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert audit(df.repartition(3), pair_sources=2, shard_rows=9, salts=3, block_terms=150) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_of_hot_terms_in_small_blocks(spark):
    """A term that is frequent in every block is dealt over salts and still counted once."""
    rows = texts(2, 400) + [(1000 + i, "common " * (i % 4) + f"rare{i // 29}x", "en", f"s{i % 5}") for i in range(900)]
    runs = divergence.partial_runs(docs(spark, rows).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).repartition(4), 30, 8).collect()
    assert {r.salt > 0 for r in runs if r.term == "common"} == {True, False}
    assert audit(docs(spark, rows).repartition(4), top=5) == plain_audit(rows, top=5)


def test_share_is_exact_for_great_counts():
    rng = random.Random(7)
    pairs = [(n, whole) for whole in (1, 7, 10**6 + 3, 2**53 - 1) for n in (0, 1, whole // 3, whole - 1, whole)] + [(rng.randint(0, w), w) for w in (rng.randint(1, 2**53) for _ in range(500))]
    got = divergence._share(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert got.tolist() == [1 + 10**9 * n // w for n, w in pairs]


def test_audit_of_empty_tables(spark):
    assert audit(docs(spark, [])) == []
    assert audit(docs(spark, [(1, None, None, None)])) == []
    assert audit(docs(spark, [(1, "", "a", "x"), (2, "", "a", "y")])) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]


@pytest.mark.parametrize("name", ["op12_curriculum", "op13_divergence"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    cols = ", ".join(sorted(got.columns))
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr) == sorted(con.sql(f"SELECT {cols} FROM ({queries.ORACLES[name]})").fetchall(), key=repr)
