"""Vector code compression: product codes whose codebooks are fitted by Heap Lloyd, exactly.

Vectors become integers, lie in blocks, and are cut in parts. A block keeps, for each part and entry, a heap of the
parts assigned to the entry, keyed by the lower bound of the distance to any other entry minus the upper bound of
the distance to its own, plus the entry's cumulative drift at the time of the push. A heap is kept as ascending keys,
which is a heap whose pops are a prefix. A round adds to an entry's cumulative drift how far it moved and how far
the farthest other entry moved; only parts whose key that sum has passed are popped and rescanned over all
entries in integers, then pushed with new bounds. Bounds are rounded against the part, so parts that stay in a heap
are nearest to their entry beyond doubt, ties included.

A round reads the blocks, writes them with new codes and heaps, and reads back only the changes of sums and counts,
which are added up by Spark; the driver sees the codebooks and nothing that grows with the table. The round before the
last is deleted, so the disk holds two rounds. A lost executor costs the blocks of its tasks.

Cases: vectors that are null, hold null or are not finite are left out, all else is kept; a null id comes last among the ids that start
the codebooks; repeated rows and ids are vectors of their own; with fewer than 16 vectors the codebooks have as many entries as there are vectors;
null labels are one group; further columns are left out, whatever their names; an empty table gives no rows. Vectors of other lengths than the
first one's, lengths that don't divide into the parts, and components beyond 2^27 steps (32768), whose errors would leave 64 bits, are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, drop_path, spread_join, tidy

PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
#: Vectors of a block.
BLOCK = 1 << 15
LARGEST = 1 << 27
#: Distances that a rescan holds at once.
CELLS = 1 << 21
#: Relative and absolute error that bounds are widened by; doubles and square roots err by far less.
SLACK = 1e-9


def steps(x: np.ndarray) -> np.ndarray:
    """Components as integers, floor(STEPS * x), in 16 bits where they fit."""
    y = np.floor(x.astype(np.float64) * STEPS)
    top = np.abs(y).max(initial=0)
    if top > LARGEST:
        raise ValueError("a component is beyond 2^27 steps")
    return y.astype(np.int16 if top < 1 << 15 else np.int32)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (n, entries) as exact integers. ``x`` (n, width), ``entries`` (entries, width)."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        gap = x[:, d].astype(np.int64)[:, None] - entries[None, :, d]
        out += gap * gap
    return out


def rescan(x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries (ties to the lower index) of parts, and the keys to push them with."""
    code, key = np.empty(len(x), np.uint8), np.empty(len(x), np.float64)
    step = max(1, CELLS // len(entries))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], entries)
        near = d.argmin(1)
        row = np.arange(len(d))
        upper = np.sqrt(d[row, near].astype(np.float64))
        d[row, near] = np.iinfo(np.int64).max
        lower = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(d), 1e18)
        gone = drift[near]
        code[at : at + step] = near
        key[at : at + step] = lower - upper + gone - SLACK * (1 + lower + upper + gone)
    return code, key


def to_float32_below(x: np.ndarray) -> np.ndarray:
    """The nearest smaller 32-bit number: a key may only lose by rounding."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


class Heaps:
    """Heaps of one part position in one block, one for each entry: members by (entry, key), so a heap is a slice in ascending order."""

    def __init__(self, code: np.ndarray, key: np.ndarray, member: np.ndarray):
        self.code, self.key, self.member = code, key, member

    @classmethod
    def of(cls, code: np.ndarray, key: np.ndarray) -> Heaps:
        order = np.lexsort((key, code))
        return cls(code[order], key[order], order.astype(np.int32))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Take out, from the top of each heap, what the entry's cumulative drift has reached. Returns the members."""
        ends = np.searchsorted(self.code, np.arange(len(drift) + 1))
        out = np.zeros(len(self.code), bool)
        for e, (at, end) in enumerate(zip(ends[:-1], ends[1:])):
            out[at : at + np.searchsorted(self.key[at:end], drift[e], side="right")] = True
        popped = self.member[out]
        self.code, self.key, self.member = self.code[~out], self.key[~out], self.member[~out]
        return popped

    def push(self, code: np.ndarray, key: np.ndarray, member: np.ndarray) -> None:
        both = np.concatenate([self.code, code]), np.concatenate([self.key, key]), np.concatenate([self.member, member])
        order = np.lexsort((both[1], both[0]))
        self.code, self.key, self.member = (b[order] for b in both)


def _sums(x: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """(k, width + 1): sums of the parts of each entry and, last, their number."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    order = np.argsort(code, kind="stable")
    at = np.searchsorted(code[order], np.arange(k + 1))
    total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order], 0, dtype=np.int64)])
    out[:, :-1], out[:, -1] = total[at[1:]] - total[at[:-1]], np.diff(at)
    return out


BLOCK_SQL = "wide boolean, ints binary, codes binary, heap_code binary, heap_key binary, heap_member binary, popped long, delta binary"


def _ints(row: dict) -> np.ndarray:
    return np.frombuffer(row["ints"], np.int32 if row["wide"] else np.int16)


def _first(x: np.ndarray, books: np.ndarray) -> dict:
    """A block's codes, heaps and sums in the first round, where every part is rescanned."""
    parts, k, width = books.shape
    codes = np.empty((len(x), parts), np.uint8)
    heaps, delta = [], np.empty((parts, k, width + 1), np.int64)
    for p in range(parts):
        xp = x[:, p * width : (p + 1) * width]
        codes[:, p], key = rescan(xp, books[p], np.zeros(k))
        heaps.append(Heaps.of(codes[:, p], to_float32_below(key)))
        delta[p] = _sums(xp, codes[:, p], k)
    return _packed(codes, heaps, len(x) * parts, delta)


def _next(row: dict, books: np.ndarray, drift: np.ndarray) -> dict:
    """A block after a round: what drift has reached is popped, rescanned and pushed; moved parts change the sums."""
    parts, k, width = books.shape
    x = _ints(row).reshape(-1, parts * width)
    n = len(x)
    codes = np.frombuffer(row["codes"], np.uint8).reshape(n, parts).copy()
    code, key, member = (np.frombuffer(row[f"heap_{c}"], t).reshape(parts, n) for c, t in (("code", np.uint8), ("key", np.float32), ("member", np.int32)))
    heaps, delta, popped = [], np.zeros((parts, k, width + 1), np.int64), 0
    for p in range(parts):
        heap = Heaps(code[p], key[p], member[p])
        out = heap.pop(drift[p])
        if len(out):
            xp = x[out, p * width : (p + 1) * width]
            new, fresh = rescan(xp, books[p], drift[p])
            old = codes[out, p]
            moved = new != old
            if moved.any():
                delta[p] = _sums(xp[moved], new[moved], k) - _sums(xp[moved], old[moved], k)
            codes[out, p] = new
            heap.push(new, to_float32_below(fresh), out)
            popped += len(out)
        heaps.append(heap)
    return _packed(codes, heaps, popped, delta)


def _packed(codes: np.ndarray, heaps: list[Heaps], popped: int, delta: np.ndarray) -> dict:
    join = lambda name: b"".join(getattr(h, name).tobytes() for h in heaps)
    return {"codes": codes.tobytes(), "heap_code": join("code"), "heap_key": join("key"), "heap_member": join("member"), "popped": popped, "delta": delta.tobytes()}


def _added(changes: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, int]:
    """The sum of all blocks' changes, and the number of parts popped: each task adds its blocks, Spark adds the tasks."""
    cells = int(np.prod(shape))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + 1, np.int64)
        for b in batches:
            for d, n in zip(b.column("delta"), b.column("popped").to_pylist()):
                total[:-1] += np.frombuffer(d.as_buffer(), np.int64)
                total[-1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells + 1, dtype=np.int32)), pa.array(total)], ["cell", "v"])

    found = changes.select("delta", "popped").mapInArrow(add, "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(cells + 1, np.int64)
    for r in found:
        out[r.cell] = r.v
    return out[:-1].reshape(shape), int(out[-1])


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(parts, entries): how much a key may lose by entries that moved: the own entry's way and the longest way of another one."""
    way = np.sqrt(((new - old) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
    out = np.empty_like(way)
    for e in range(way.shape[1]):
        out[:, e] = way[:, e] + np.delete(way, e, 1).max(1, initial=0.0)
    return out


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray, list[int]] | None:
    """(blocks with final codes, codebooks (parts, entries, width), parts popped in each assignment); None for a table without vectors.

    Codebooks start as the parts of the vectors with the least ids.
    """
    far = F.lit(float("inf"))
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < far))
    kept = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull() & good)
    start = kept.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    if not start:
        return None
    length = len(start[0].vec)
    if not length or length % parts or any(len(r.vec) != length for r in start):
        raise ValueError(f"vectors need one length that divides into {parts} parts")
    books = np.stack([steps(np.array(r.vec, np.float64)) for r in start]).astype(np.int64).reshape(len(start), parts, -1).swapaxes(0, 1).copy()
    ids, labels = (to_arrow_type(kept.schema[c].dataType) for c in ("id", "label"))
    head = pa.schema([("ids", pa.list_(ids)), ("labels", pa.list_(labels))])
    body = [("wide", pa.bool_()), *((c, pa.binary()) for c in ("ints", "codes", "heap_code", "heap_key", "heap_member")), ("popped", pa.int64()), ("delta", pa.binary())]
    schema = pa.schema([*head, *body])
    sql = f"ids array<{kept.schema['id'].dataType.simpleString()}>, labels array<{kept.schema['label'].dataType.simpleString()}>, {BLOCK_SQL}"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made():
            t = pa.Table.from_batches(held).combine_chunks()
            vec = t.column("vec").combine_chunks()
            if not pc.all(pc.equal(pc.list_value_length(vec), length)).as_py():
                raise ValueError("vectors differ in length")
            x = steps(vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, length))
            listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(t.column(c).chunks))
            rest = {"wide": x.dtype == np.int32, "ints": x.tobytes()} | _first(x, books)
            return pa.RecordBatch.from_arrays([listed("id").cast(head[0].type), listed("label").cast(head[1].type), *(pa.array([rest[c]], kind) for c, kind in body)], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, block):
                piece = b.slice(at, block)
                if n and n + piece.num_rows > block:
                    yield made()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield made()

    def again(now: np.ndarray, drift: np.ndarray):
        @tidy
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c for c, _ in body]
            for b in batches:
                for at in range(b.num_rows):
                    one = b.slice(at, 1)
                    row = {c: one.column(c)[0].as_py() for c in names if c != "delta"}
                    new = _next(row, now, drift)
                    yield pa.RecordBatch.from_arrays([one.column(c) if c not in new else pa.array([new[c]], schema.field(c).type) for c in schema.names], schema=schema)

        return scan

    shape = (*books.shape[:2], books.shape[2] + 1)
    state, sums, drift, popped = cut(kept.mapInArrow(tidy(load), sql), "codes-0"), np.zeros(shape, np.int64), np.zeros(books.shape[:2]), []
    for k in range(rounds):
        change, out = _added(state, shape)
        sums += change
        popped.append(out)
        count = sums[..., -1:]
        new = np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), books)
        drift = drift + moved_by(books, new)
        books, before = new, state
        state = cut(state.mapInArrow(again(books, drift), sql), f"codes-{k + 1}")
        drop_path(before)
    return state, books, [*popped, _added(state, shape)[1]]


def digest(books: np.ndarray) -> str:
    """Hash of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    fitted = fit(df, id_col, vec_col, label_col)
    if fitted is None:
        return df.sparkSession.createDataFrame([], f"{id_col} {kinds[id_col]}, code string, error long, label_error long, codebooks_sha256 string")
    state, books, _ = fitted
    parts, _, width = books.shape

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = {c: b.column(c)[at].as_py() for c in ("wide", "ints", "codes")}
                x = _ints(row).reshape(-1, parts, width).astype(np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, parts)
                error = sum(((x[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts))
                text = row["codes"].hex()
                code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                out = pa.RecordBatch.from_arrays([b.column("ids")[at].values, b.column("labels")[at].values, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])
                for k in range(0, out.num_rows, 10_000):
                    yield out.slice(k, 10_000)

    rows = cut(state.select("ids", "labels", "wide", "ints", "codes").mapInArrow(tidy(unpack), f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"), "coded")
    drop_path(state)
    named = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    sums = named.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return spread_join(named, sums, "_label", "id").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
