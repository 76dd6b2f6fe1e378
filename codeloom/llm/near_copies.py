"""Near copies by Jaccard similarity of word shingles, for the pipeline; ``op4`` keeps its own rule (simhash.py).

Two texts are linked where the sets of their five-word shingles have a Jaccard similarity of at least 0.8. They are
found as operator 4 finds its links, through SimHash fingerprints and pivot distance tables, but in the space of sets, where
linked sets of ``a`` and ``b`` shingles differ by at most (a + b) / 9. (A fingerprint of a whole text bounds nothing here: such pairs differ by up
to 11 of its 64 bits and more.)

The shingles' hashes are cut into parts by their leading bits, a power of two near the size of the set or a quarter of it.
Sets with d differences differ in at most d parts, so of the first d + 1 parts that either fills one is the same in both: there their SimHash fingerprints are
equal, and so are the fingerprints' distances to every pivot. Rows meet by those equal vectors, one table for each part. As d is at most a
fourth of either size, n // 4 + 1 tables of a set are exact; ``TABLES`` at most are used: that is exact below 96 shingles, and above
a pair at exactly 0.8 is missed with a probability of 2e-5 at most (one at 0.9 with 3e-11). ``tables=None`` takes all of them and misses
nothing. Sets that fill too few parts for the argument meet by parts of one shingle besides. A set that a linked one of a
coarser cut may meet has that cut's parts too.

Of the sets that meet, those are discarded whose distances to pivots differ by more than linked sets' can: 32 disjoint
pivots, whose differences add up to the maximum difference over all their unions. The rest are verified on their full sets.

Only distinct sets meet, and cells with the same members count once. In a cell, links are found by a search over an
inverted index, so only a spanning forest leaves the task. Cells of over ``GROUP_SHINGLES`` are dealt out as pairs of chunks.

Cases: null and empty texts are copies of each other; a text of fewer than five words is one shingle; a null id never names a
component, and its row stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, spread_join, tidy, utf8, without
from .components import components
from .simhash import pivots

SEED, SHINGLE_WORDS = 42, 5
#: Jaccard similarity of linked sets, as a fraction.
LEAST, OF = 4, 5
#: Pivot tables that a set takes part in for one cut, at most; None takes as many as are exact.
TABLES: int | None = 24
#: From this size on, parts are twice as large.
LONG = 128
#: Disjoint pivots of the full-width distances.
COORDS = 32
#: Shingles of a cell that one task takes; larger cells are dealt out as pairs of chunks.
GROUP_SHINGLES = 1 << 20

_PIVOTS = np.array(pivots(), np.uint64)
_RANDOM = np.random.default_rng(SEED)
_MIX = _RANDOM.integers(0, 2**64, (3, len(_PIVOTS)), np.uint64) | np.uint64(1)


def shingles(raw: bytes, words_in: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending; A-Z count as a-z, words end at ASCII white space."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    k = min(words_in, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts)))


def set_key(own: np.ndarray) -> int:
    """A hash of the whole set, signed."""
    x = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def width_of(n: int) -> int:
    """Leading bits that tell the parts of a set of ``n`` shingles."""
    return max(n.bit_length() - (1 if n < LONG else 2), 0)


def pivot_cells(own: np.ndarray, width: int, most: int) -> tuple[np.ndarray, bool]:
    """For each of the first ``most`` parts that ``own`` (ascending) fills, a hash of the part and its fingerprint's distances to the pivots.

    Also whether it fills that many.
    """
    part = own >> np.uint64(64 - width) if width else np.zeros(len(own), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    end = int(starts[most]) if len(starts) > most else len(own)
    enough = len(starts) >= most
    starts = starts[:most]
    counts = np.add.reduceat(np.unpackbits(own[:end].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
    sizes = np.diff(starts, append=end)
    fps = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8")
    distances = np.bitwise_count(fps ^ _PIVOTS).astype(np.uint64)
    return distances @ _MIX[0] + part[starts] * _MIX[1, 0] + _MIX[2, :1] * np.uint64(width), enough


def cells(own: np.ndarray, tables: int | None = TABLES) -> np.ndarray:
    """The cells of a set in the pivot tables of its own cut and of that of the least set that it may be linked to, signed; none for an empty set."""
    n = len(own)
    if not n:
        return np.empty(0, np.int64)
    most = min(n // 4 + 1, tables or n)
    found, sparse = [], False
    for width in {width_of(n), width_of(-(-n * LEAST // OF))}:
        own_cells, enough = pivot_cells(own, width, most)
        found.append(own_cells)
        sparse |= not enough
    if sparse:
        found.append(pivot_cells(own, 64, most)[0])
    return np.unique(np.concatenate(found).view(np.int64))


def sketches(df: DataFrame, id_col: str, text_col: str, tables: int | None = TABLES) -> DataFrame:
    """``id``, ``body`` (hash of the text), ``key`` (of the shingle set), its size ``n`` and ``cells``, for each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingles(r) for r in utf8(b.column("text").to_pylist())]
            places = pa.array([cells(s, tables) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "body": b.column("body"), "key": pa.array(map(set_key, sets), pa.int64()),
                "n": pa.array(map(len, sets), pa.int64()), "cells": places})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(scan), "id long, body long, key long, n long, cells array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """``key`` and ``shingles`` (their 64-bit hashes) of the distinct sets in ``text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small_batches(batches):
            fresh = {set_key(s): s.tobytes() for s in map(shingles, utf8(b.column("text").to_pylist()))}
            fresh = {k: s for k, s in fresh.items() if k not in seen}
            seen |= fresh.keys()
            yield pa.RecordBatch.from_pydict({"key": pa.array(fresh.keys(), pa.int64()), "shingles": pa.array(fresh.values(), pa.binary())})

    return texts.select("text").mapInArrow(tidy(scan), "key long, shingles binary").dropDuplicates(["key"])


def dealt(sizes: DataFrame, most: int) -> DataFrame:
    """(cell, key, chunk) of cells with two sets or more: chunk 0 in small cells; a larger cell's rows go to every pair of chunks that has theirs."""
    whole = sizes.groupBy("cell").agg(F.count("key").alias("members"), F.sum("n").alias("weight"), F.min("key").alias("low"),
        F.max("key").alias("high"), F.bit_xor(F.xxhash64("key")).alias("mix")).filter("members > 1")
    whole = whole.groupBy("members", "weight", "low", "high", "mix").agg(F.min("cell").alias("cell"))
    whole = whole.select("cell", F.when(F.col("weight") > most, F.ceil(2 * F.col("weight") / most).cast("int")).alias("parts"))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, own) * F.col("parts") + F.greatest(o, own))
    return sizes.join(whole, "cell").select("cell", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)).alias("chunk"))


def pivot_distances(owners: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` sets, how many of its shingles lie in each of ``COORDS`` disjoint pivots, whose distances these counts give."""
    return np.bincount(owners * COORDS + (hashes % np.uint64(COORDS)).astype(np.int64), minlength=n * COORDS).reshape(n, COORDS).astype(np.int32)


def search(keys: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(key, least key) pairs that join the linked sets of one group.

    From each start, sets not yet reached are narrowed by size and pivot distances, then verified.
    """
    n = len(keys)
    order = np.argsort(list(map(len, sets)), kind="stable")
    keys, sets = keys[order], [sets[i] for i in order]
    size = np.array(list(map(len, sets)), np.int64)
    members = np.repeat(np.arange(n), size)
    hashes = np.concatenate(sets)
    coords = pivot_distances(members, hashes, n)
    values, codes = np.unique(hashes, return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(size)])
    owners = members[np.argsort(codes, kind="stable")]
    count = np.bincount(codes, minlength=len(values))
    first = np.cumsum(count) - count
    free = np.ones(n, bool)
    out = []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        reached, front = [start], [start]
        while front and free.any():
            x = front.pop()
            lo, hi = np.searchsorted(size, [-(-size[x] * LEAST // OF), size[x] * OF // LEAST + 1])
            apart = np.abs(coords[lo:hi] - coords[x]).sum(axis=1)
            near = lo + np.flatnonzero(free[lo:hi] & ((OF + LEAST) * apart <= (OF - LEAST) * (size[x] + size[lo:hi])))
            if not len(near):
                continue
            mine = codes[edges[x] : edges[x + 1]]
            many = count[mine]
            at = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(owners[at], minlength=n)[near]
            near = near[OF * shared >= LEAST * (size[x] + size[near] - shared)].tolist()
            free[near] = False
            reached += near
            front += near
        if len(reached) > 1:
            least = int(keys[reached].min())
            out += [(int(k), least) for k in keys[reached] if k != least]
    return out


def link(groups: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` from rows (cell, chunk, key, shingles) that lie together and sorted by (cell, chunk)."""

    def found(held: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        return search(np.array([k for k, _ in held], np.int64), [np.frombuffer(s, np.uint64) for _, s in held]) if len(held) > 1 else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark = [], None
        edges: list[tuple[int, int]] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])
        for b in small_batches(batches):
            for cell, chunk, key, own in zip(*(b.column(c).to_pylist() for c in ("cell", "chunk", "key", "shingles"))):
                if mark != (cell, chunk):
                    edges += found(held)
                    held, mark = [], (cell, chunk)
                held.append((key, own))
            if len(edges) > 50_000:
                yield batch()
                edges = []
        edges += found(held)
        yield batch()

    return groups.mapInArrow(tidy(scan), "u long, v long")


def components_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = GROUP_SHINGLES, tables: int | None = TABLES) -> DataFrame:
    """``id``, ``body`` and ``component_id`` (least id reachable by links) of every row."""
    docs = cut(sketches(df, id_col, text_col, tables), "sketches")
    distinct = cut(docs.groupBy("key").agg(F.min("id").alias("first_id"), F.min("body").alias("body"), F.first("n").alias("n"),
        F.first("cells").alias("cells")), "distinct-sets")
    placed = cut(dealt(distinct.select("key", "n", F.explode("cells").alias("cell")), most), "cells")
    wanted = distinct.join(placed.select("key").distinct(), "key", "left_semi").select(F.col("body").alias("_body"))
    texts = df.select(F.col(text_col).alias("text")).join(wanted, F.xxhash64("text") == F.col("_body"), "left_semi")
    sets = cut(sets_of(texts), "sets")
    roots = components(link(placed.join(sets, "key").select("cell", "chunk", "key", "shingles").repartition("cell", "chunk").sortWithinPartitions(
        "cell", "chunk")))
    named = cut(distinct.join(roots, distinct.key == roots.node, "left").select("key", "first_id", F.coalesce("root", "key").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_key = spread_join(named, least, "root", "key").select("key", "component_id")
    return spread_join(docs, by_key, "key", "id").select("id", "body", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay: of each component, those with its least id.

    Each row is judged by its own text, also where an id repeats with different texts. Rows without an id stay.
    """
    gone = components_of(df, id_col, text_col).filter(F.col("id") != F.col("component_id")).select("id", "body").distinct()
    return without(df, gone, [F.col(id_col).cast("long"), F.xxhash64(text_col)])
