"""Repeated passages: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Documents are dealt into buckets of a few megabytes, whatever their ids. A bucket's task hashes every window of its
whole texts and sends the distinct hashes, each with the least id that has it, to the tasks that own their ranges: a fixed
number of messages a bucket, so messages grow with the input. A range's task finds the least id of each hash, and answers with one
bit for each hash sent: set where a smaller id has it. The bucket's task, with the same documents again, joins these bits with
what it knows of its own documents' ids and merges repeated windows into maximal intervals, which are removed.

A window is sent once for each bucket that has it, so a passage in a third of all documents costs each bucket one
hash. Over ``OWNERS`` buckets meet in groups first; a group then sends its distinct hashes on as one owner, in
finer ranges, so a task's memory doesn't grow with the input. Hashes are two independent 32-bit residues, 64 bits together: in a corpus
of n distinct windows about n^2 / 2^65 pairs of them meet by chance.

Cases: a null text has no words; texts shorter than a window stay whole; very long texts are hashed in segments; white space is that
of ASCII; a null id sorts after all others; rows that share an id, or have none, never remove each other's words and may lie in different
buckets; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, free_encoder, trim, utf8

WINDOW = 50
#: A bucket's bytes of text lie between these, so that small inputs still make many tasks.
LEAST_BUCKET, MOST_BUCKET = 2 << 20, 4 << 20
#: Words hashed at once.
SEGMENT = 1 << 14
#: Owners of hashes that meet in one task of a range, and the bits that tell ranges apart (fewer for up to ``FEW`` owners).
OWNERS, RANGE_BITS, FEW, FEW_BITS = 4096, 11, 512, 8
#: Bytes of messages from which a task of a range gives its memory back at once.
LARGE_MEETING = 4 << 20
#: Two primes below 2^32 and a base for each.
PRIMES, BASES = (4294967291, 4294967279), (2862933555, 3935559001)
LAST_ID = (1 << 63) - 1


@lru_cache(maxsize=8)
def _powers(prime: int, base: int, size: int) -> np.ndarray:
    """base^0, base^1, ... modulo prime; ``size`` is a power of two."""
    out = np.ones(size, np.uint64)
    n, step = 1, base % prime
    while n < size:
        out[n : 2 * n] = out[:n] * np.uint64(step) % np.uint64(prime)
        n, step = 2 * n, step * step % prime
    return out


def _residues(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, prime: int, base: int) -> np.ndarray:
    """Polynomial hashes of text[start:stop], each as if it began at 0."""
    size = 1 << max(10, int(len(text)).bit_length())
    p = np.uint64(prime)
    terms = text.astype(np.uint64) * _powers(prime, base, size)[: len(text)]
    if len(text) >= 1 << 23:
        terms %= p
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    back = _powers(prime, pow(base, -1, prime), size)
    return (sums[stops] - sums[starts]) % p * back[starts] % p


def window_hashes(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of every ``window`` consecutive words."""
    out = []
    for at in range(0, len(words) - window + 1, SEGMENT):
        part = words[at : at + SEGMENT + window - 1]
        text = np.frombuffer(b" ".join(part), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(part) - window + 1]
        high, low = (_residues(text, starts, ends[window - 1 :], p, b) for p, b in zip(PRIMES, BASES))
        out.append(high << np.uint64(32) | low)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, ascending; where each is first; and the place of every value among them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    distinct, first = ordered[new], order[new]
    del ordered
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    place = np.empty(len(values), np.int32)
    place[order] = rank
    return distinct, first, place


class Bucket:
    """The documents of one bucket in id order, with the hashes of all their windows; words are split one document at a time."""

    def __init__(self, table: pa.Table, window: int):
        ids = np.array([LAST_ID if i is None else i for i in table.column("id").to_pylist()], np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.texts = table.column("text")
        each = [window_hashes(self.words(k), window) for k in range(len(ids))]
        self.bounds = np.cumsum([0, *map(len, each)])
        every = np.concatenate([*each, np.empty(0, np.uint64)])
        del each
        self.distinct, first, self.place = _ranked(every)
        self.first_id = self.ids[np.searchsorted(self.bounds, first, side="right") - 1]

    def text(self, k: int) -> str | None:
        return self.texts[int(self.order[k])].as_py()

    def words(self, k: int) -> list[bytes]:
        return utf8([self.text(k)])[0].split()


def _edges(distinct: np.ndarray, first: int, bits: int, depth: int) -> np.ndarray:
    """Where each of the 2^bits ranges that share the ``depth`` high bits ``first`` begins among sorted hashes, and the end."""
    low = 64 - depth - bits
    cuts = np.array([((first << bits) + r) << low for r in range(1, 1 << bits)], np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, cuts), [len(distinct)]])


def _planes(values: np.ndarray) -> bytes:
    """Byte plane by byte plane, so that shuffle compression finds the leading zeros."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def _packed(hashes: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted hashes as differences, and their ids above the least of them."""
    base = ids.min()
    return int(base).to_bytes(8, "little", signed=True) + _planes(np.diff(hashes, prepend=np.uint64(0))) + _planes((ids - base).view(np.uint64))


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = 8 + (len(raw) - 8) // 2
    base = np.int64(int.from_bytes(raw[:8], "little", signed=True))
    return np.cumsum(_from_planes(raw[8:half]), dtype=np.uint64), _from_planes(raw[half:]).view(np.int64) + base


SENT = pa.schema([("owner", pa.int64()), ("range", pa.int64()), ("hashes", pa.binary())])
ANSWERED = pa.schema([("owner", pa.int64()), ("range", pa.int64()), ("bits", pa.binary())])


def _send(owner: int, hashes: np.ndarray, ids: np.ndarray, first: int, bits: int, depth: int) -> pa.Table:
    """One message for each range that has hashes."""
    e = _edges(hashes, first, bits, depth).tolist()
    full = [r for r in range(1 << bits) if e[r] < e[r + 1]]
    blobs = [_packed(hashes[e[r] : e[r + 1]], ids[e[r] : e[r + 1]]) for r in full]
    return pa.table([[owner] * len(full), [(first << bits) + r for r in full], blobs], schema=SENT)


class Meeting:
    """The messages of several owners for one range: their hashes, and the least id of each."""

    def __init__(self, table: pa.Table):
        self.owners, self.range = table.column("owner").to_pylist(), table.column("range")[0].as_py()
        sent = [_unpacked(x) for x in table.column("hashes").to_pylist()]
        self.edges = np.cumsum([0, *(len(h) for h, _ in sent)])
        self.ids = np.concatenate([i for _, i in sent])
        hashes = np.concatenate([h for h, _ in sent])
        del sent
        self.distinct, _, self.place = _ranked(hashes)
        self.least = np.full(len(self.distinct), LAST_ID, np.int64)
        np.minimum.at(self.least, self.place, self.ids)

    def answers(self, elsewhere: np.ndarray | None = None) -> pa.Table:
        """A bit for each hash sent: whether a smaller id has it, here or (by distinct hash) ``elsewhere``."""
        less = self.least[self.place] < self.ids
        if elsewhere is not None:
            less |= elsewhere[self.place]
        parts = [(o, less[a:z]) for o, a, z in zip(self.owners, self.edges[:-1].tolist(), self.edges[1:].tolist())]
        told = [(o, np.packbits(p).tobytes()) for o, p in parts if p.any()]
        return pa.table([[o for o, _ in told], [self.range] * len(told), [x for _, x in told]], schema=ANSWERED)


def smaller_ids(sent: DataFrame, owners: int, bits: int, depth: int, most: int) -> DataFrame:
    """(owner, range, bits) to the messages of ``owners`` owners in ranges of ``depth`` high bits."""
    kinds = "owner long, range long, bits binary"

    def met(t: pa.Table) -> pa.Table:
        out = Meeting(t).answers()
        if t.nbytes > LARGE_MEETING:
            trim()
        return out

    if owners <= most:
        return sent.groupBy("range").applyInArrow(met, kinds)
    sent = cut(sent, "window-hashes").withColumn("group", F.floor(F.col("owner") / most))

    def pass_on(t: pa.Table) -> pa.Table:
        m = Meeting(t)
        out = _send(m.owners[0] // most, m.distinct, m.least, m.range, bits, depth)
        del m
        if t.nbytes > LARGE_MEETING:
            trim()
        return out

    def come_back(t: pa.Table, above: pa.Table) -> pa.Table:
        if not t.num_rows:
            return ANSWERED.empty_table()
        m = Meeting(t)
        e = _edges(m.distinct, m.range, bits, depth).tolist()
        elsewhere = np.zeros(len(m.distinct), bool)
        for r, raw in zip(above.column("range").to_pylist(), above.column("bits").to_pylist()):
            r -= m.range << bits
            elsewhere[e[r] : e[r + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=e[r + 1] - e[r]).astype(bool)
        out = m.answers(elsewhere)
        del m
        if t.nbytes > LARGE_MEETING:
            trim()
        return out

    up = sent.groupBy("range", "group").applyInArrow(pass_on, "owner long, range long, hashes binary")
    above = smaller_ids(up, -(-owners // most), bits, depth + bits, most).withColumn("coarse", F.shiftright("range", bits))
    return sent.groupBy("range", "group").cogroup(above.groupBy("coarse", "owner")).applyInArrow(come_back, kinds)


def spans_of(repeated: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops, in words, of the maximal intervals that repeated windows cover."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at
    new = np.flatnonzero(np.diff(at) > window)
    return at[np.concatenate([[0], new + 1])], at[np.concatenate([new, [len(at) - 1]])] + window


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: bool = False) -> DataFrame:
    """id, kept (words left, joined by one space), n_words, n_removed and the removed ``spans`` in words.

    With ``carry``, ``kept`` is the unchanged text where nothing is removed, and a struct column ``row`` has the further columns
    of the row that the result is of, as c0, c1, ...
    """
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text_col]
    rest = F.struct(*others) if carry else F.lit(None).cast("boolean")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("row"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = size.b or 0
    share = min(MOST_BUCKET, max(LEAST_BUCKET, total // 256))
    buckets = int(min(total // share + 1, max(1, size.n)))
    bits = FEW_BITS if buckets <= FEW else RANGE_BITS
    place = F.monotonically_increasing_id()
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64(place), F.lit(buckets)).cast("long"))

    def send(table: pa.Table) -> pa.Table:
        free_encoder()
        b = Bucket(table, window)
        out = _send(table.column("bucket")[0].as_py(), b.distinct, b.first_id, 0, bits, 0)
        del b
        trim()
        return out

    def merge(docs_: pa.Table, answered: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.table([pa.array([], f.type) for f in out_schema] + [docs_.column("row")], names=[*out_schema.names, "row"])
        b = Bucket(docs_, window)
        e = _edges(b.distinct, 0, bits, 0).tolist()
        less = np.zeros(len(b.distinct), bool)
        for r, raw in zip(answered.column("range").to_pylist(), answered.column("bits").to_pylist()):
            less[e[r] : e[r + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=e[r + 1] - e[r]).astype(bool)
        kept, counts, removed, spans = [], [], [], []
        for k in range(len(b.ids)):
            words = b.words(k)
            own = b.place[b.bounds[k] : b.bounds[k + 1]]
            starts, stops = spans_of(less[own] | (b.first_id[own] < b.ids[k]), window)
            keep = np.ones(len(words), bool)
            for a, z in zip(starts.tolist(), stops.tolist()):
                keep[a:z] = False
            whole = carry and not len(starts)
            kept.append(b.text(k) if whole else b" ".join(compress(words, keep) if len(starts) else words).decode("utf-8", "surrogatepass"))
            counts.append(len(words))
            removed.append(len(words) - int(keep.sum()))
            spans.append([{"start": a, "stop": z} for a, z in zip(starts.tolist(), stops.tolist())])
        ids = docs_.column("id").take(pa.array(b.order))
        columns = [ids, pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(spans, out_schema.field("spans").type)]
        out = pa.table([*columns, docs_.column("row").take(pa.array(b.order))], names=[*out_schema.names, "row"])
        del b
        trim()
        return out

    out_schema = pa.schema([("id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    sent = dealt.groupBy("bucket").applyInArrow(send, "owner long, range long, hashes binary")
    answers = smaller_ids(sent, buckets, bits, bits, OWNERS)
    kinds = StructType.fromDDL("id long, kept string, n_words long, n_removed long, spans array<struct<start:long,stop:long>>").add("row",
        docs.schema["row"].dataType)
    merged = dealt.groupBy("bucket").cogroup(answers.groupBy("owner")).applyInArrow(merge, kinds)
    return (merged if carry else merged.drop("row")).withColumnRenamed("id", id_col)


def replace_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``df``; texts that lose words become the words left, and ``length_col`` their characters."""
    found = remove_repeats(df, id_col, text_col, window, carry=True)

    def column(i: int, c: str) -> Column:
        if c == text_col:
            return F.col("kept").alias(c)
        own = F.col(f"row.c{i}")
        return (F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(own) if c == length_col else own).alias(c)

    return found.select(*[column(i, c) for i, c in enumerate(df.columns)])


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
