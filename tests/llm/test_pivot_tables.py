"""The near-dedup stage meets through operator 4's pivot distance tables, and loses no link."""

from __future__ import annotations

import numpy as np

from codeloom.llm import near_copies, simhash

from .test_near_copies import plain_kept, texts  # noqa: F401


def linked(rng, n):
    """Two random sets with a union of n and as many differences as a similarity of 0.8 allows."""
    union = rng.integers(0, 2**64, n, np.uint64)
    side = np.zeros(n, int)
    gone = rng.permutation(n)[: n // 5]
    at = rng.integers(0, len(gone) + 1)
    side[gone[:at]], side[gone[at:]] = 1, 2
    return np.unique(union[side != 1]), np.unique(union[side != 2])


def meet(a, b, **how):
    return len(np.intersect1d(near_copies.cells(a, **how), near_copies.cells(b, **how))) > 0


def test_a_cell_is_equal_distances_of_a_parts_fingerprint():
    """Shingles whose fingerprint is as far from every pivot meet, others don't."""
    own = np.sort(np.random.default_rng(5).integers(0, 2**64, 40, np.uint64))
    got, enough = near_copies.pivot_cells(own, 3, 8)
    assert enough and len(got) == len(set(got.tolist())) == 8
    for part in range(8):
        inside = own[own >> np.uint64(61) == part]
        assert near_copies.pivot_cells(inside, 3, 1)[0].tolist() == [got[part]]
        bits = np.unpackbits(inside.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > len(inside)
        fp = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        far = np.array([(fp ^ p).bit_count() for p in simhash.pivots()], np.uint64)
        mix = near_copies._MIX
        assert got[part : part + 1] == far @ mix[0] + mix[1, :1] * np.uint64(part) + mix[2, :1] * np.uint64(3)


def test_pairs_at_the_bound_meet_always():
    """Sets of fewer than 96 shingles by the default tables, larger ones by all."""
    rng = np.random.default_rng(11)
    assert all(meet(*linked(rng, n)) for n in range(5, 96) for _ in range(60))
    assert all(meet(*linked(rng, n), tables=None) for n in (96, 127, 128, 160, 255, 256, 319, 320, 700) for _ in range(100))


def test_sets_within_one_part_meet():
    """Shingles with the same leading bits fill one part, where the sets differ."""
    for n in (5, 9, 20, 60):
        own = np.arange(1, n + 1, dtype=np.uint64)
        for at in (0, n // 2, n - 1):
            assert meet(own, np.delete(own, at))


def test_pivot_distances_discard_no_linked_set():
    rng = np.random.default_rng(2)
    for n in (5, 30, 200, 2000):
        for _ in range(20):
            a, b = linked(rng, n)
            owners, hashes = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
            x, y = near_copies.pivot_distances(owners, hashes, 2)
            assert x.sum() == len(a) and 9 * np.abs(x - y).sum() <= len(a) + len(b)
            assert near_copies.search(np.array([7, 3]), [a, b]) == [(7, 3)]


def test_all_tables_give_brute_force_groups(spark, texts):  # noqa: F811
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_copies.components_of(d, tables=None).collect()
    assert {r.id for r in rows if r.id == r.component_id} == plain_kept(texts)
