"""SimHash near-duplicates, found through pivot distance tables.

A fingerprint has 64 bits. Its distances to fixed reference fingerprints (pivots) are computed once. Two
fingerprints at most ``bits`` apart differ by at most ``bits`` in every pivot distance, over all 64
positions or over any part of them. Cut into ``bits + 2`` parts, two of their parts hold no differing bit, so
their distances to every pivot over those two parts are equal. Rows meet by those equal vectors, one table
for each two parts. Of the rows that meet, those whose full-width vectors differ anywhere by more than ``bits``
are discarded, and the rest are verified bit by bit.

Only distinct fingerprints meet. In a group, links are found by a search that leaves a fingerprint once it
is reached, so a group of many near copies costs little more than its size, and only a spanning forest leaves the
task. Groups of over ``GROUP_ROWS`` are dealt out as pairs of chunks.

Cases: a null or empty text has fingerprint zero; a null id never names a component (null where all are null);
equal texts share fingerprint and component; very long texts are fingerprinted whole; rows that share an id each get their own text's
fingerprint; further columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, spread_join, tidy, utf8, without
from .components import components

SEED, SHINGLE_WORDS, LINK_BITS = 42, 3, 3
#: Fingerprints of a group that one task takes; larger groups are dealt out as pairs of chunks.
GROUP_ROWS = 20_000
PIVOTS = 16
#: Shingles counted at once.
BLOCK = 1 << 15


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints: hashes of 0, 1, 2, ..."""
    return [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)]


def fingerprint(raw: bytes, words_in: int = SHINGLE_WORDS) -> int:
    """SimHash of word shingles, repeats included; A-Z count as a-z, words end at ASCII white space."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    k = min(words_in, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = SHINGLE_WORDS) -> DataFrame:
    """``id``, ``body`` (hash of the text) and ``fp``, the fingerprint as a signed 64-bit integer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fps = np.array([fingerprint(r, words_in) for r in utf8(b.column("text").to_pylist())], np.uint64)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "body": b.column("body"), "fp": pa.array(fps.view(np.int64))})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(scan), "id long, body long, fp long")


def parts(n: int) -> list[int]:
    """Masks that cut 64 positions into n parts of nearly equal width."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def _distances(mask: int) -> list[Column]:
    """Distances to the pivots over the positions in ``mask``."""
    return [F.bit_count(F.col("fp").bitwiseXOR(_signed(p)).bitwiseAND(_signed(mask))) for p in pivots()]


def pivot_tables(distinct: DataFrame, bits: int) -> DataFrame:
    """``fp`` once for each two parts, with ``cell``: which parts, and the distances to every pivot over them."""
    masks = [a | b for a, b in combinations(parts(bits + 2), 2)]
    cells = F.array(*[F.xxhash64(F.lit(i), *_distances(m)) for i, m in enumerate(masks)])
    return distinct.select("fp", F.explode(cells).alias("cell"))


def dealt(tables: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """Add ``chunk``: 0 in cells of up to ``most`` rows; a larger cell's rows go to every pair of chunks that has theirs."""
    large = tables.groupBy("cell").count().filter(F.col("count") > most).select("cell", F.ceil(2 * F.col("count") / most).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.least(o, own) * F.col("n") + F.greatest(o, own))
    chunks = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(others)
    return tables.join(large, "cell", "left").select("cell", "fp", F.explode(chunks).alias("chunk"))


def search(fps: np.ndarray, bits: int, coords: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node) pairs that join the linked fingerprints of one group.

    ``coords`` has a row of pivot distances for each fingerprint. From each start, rows not yet reached are
    narrowed by the pivot distances, then verified.
    """
    order = np.argsort(coords[:, 0], kind="stable")
    free_fp, free_co = fps[order], coords[order]
    out = []
    while len(free_fp):
        reached, front = [free_fp[0]], [(free_fp[0], free_co[0])]
        free_fp, free_co = free_fp[1:], free_co[1:]
        while front and len(free_fp):
            x, c = front.pop()
            lo, hi = np.searchsorted(free_co[:, 0], [int(c[0]) - bits, int(c[0]) + bits + 1])
            near = lo + np.flatnonzero(np.abs(free_co[lo:hi] - c).max(axis=1) <= bits) if hi > lo else np.empty(0, np.int64)
            near = near[np.bitwise_count(free_fp[near] ^ x) <= bits]
            if len(near):
                reached += free_fp[near].tolist()
                front += zip(free_fp[near], free_co[near])
                keep = np.ones(len(free_fp), bool)
                keep[near] = False
                free_fp, free_co = free_fp[keep], free_co[keep]
        if len(reached) > 1:
            signed = np.array(reached, np.uint64).view(np.int64)
            least = int(signed.min())
            out += [(int(s), least) for s in signed if s != least]
    return out


def _full_distances(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ np.uint64(p)) for p in pivots()], axis=1).astype(np.int8)


def link(groups: DataFrame, bits: int) -> DataFrame:
    """Edges ``u``, ``v`` from rows (cell, chunk, fp) that lie together and sorted by (cell, chunk)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Fingerprints of each group with at least two rows; a group may go over many batches."""
        held, mark = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, chunk = b.column("cell").to_numpy(), b.column("chunk").to_numpy()
            fp = b.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1])]))
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)]):
                if a == 0 and mark == (cell[0], chunk[0]):
                    held.append(fp[a:z])
                    continue
                if held and sum(map(len, held)) > 1:
                    yield np.concatenate(held)
                held, mark = [fp[a:z]], (cell[a], chunk[a])
        if held and sum(map(len, held)) > 1:
            yield np.concatenate(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for fps in runs(batches):
            found += search(fps, bits, _full_distances(fps))
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

    return groups.mapInArrow(tidy(scan), "u long, v long")


def components_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = SHINGLE_WORDS, bits: int = LINK_BITS) -> DataFrame:
    """``id``, ``body`` (hash of the text), ``fp`` and ``component_id`` (least id reachable by links) of every row."""
    docs = cut(fingerprints(df, id_col, text_col, words_in), "fingerprints")
    distinct = cut(docs.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    placed = dealt(pivot_tables(distinct, bits)).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk")
    roots = components(link(placed, bits))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = spread_join(named, least, "root", "fp").select("fp", "component_id")
    return spread_join(docs, by_fp, "fp", "id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = SHINGLE_WORDS, bits: int = LINK_BITS) -> DataFrame:
    """id, fingerprint (hex) and component_id (least id reachable by links) of every row."""
    out = components_of(df, id_col, text_col, words_in, bits)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = SHINGLE_WORDS, bits: int = LINK_BITS) -> DataFrame:
    """All columns of the rows that stay: of each component, those with its least id.

    Each row is judged by its own text, also where an id repeats with different texts. Rows without an id stay.
    """
    found = components_of(df, id_col, text_col, words_in, bits)
    gone = found.filter(F.col("id") != F.col("component_id")).select("id", "body").distinct()
    return without(df, gone, [F.col(id_col).cast("long"), F.xxhash64(text_col)])
