"""Best-fit packing in bulk-synchronous rounds of DataFrame sweeps over range-sorted runs.

Pieces are range-sorted by length and ranked within their length in written partitions. Pieces of one length are alike,
and so are sequences of one gap, so rounds work on tables of runs: pieces left by length, and gaps by size. A round
sorts both on one line and sweeps it: every gap takes the longest piece that fits and that no smaller gap
takes, which gives every piece its best fit, longest first. It is a matching of brackets: a run of pieces opens levels, a run of gaps
closes the uppermost ones, and at each level a gap meets the piece before it. Ranks share the pieces of a length among the gaps that
meet it; where pieces of that length are left over, a gap takes several at once. Gaps are updated, and the next round
begins. Sequences are opened when no piece fits: as many as the tokens left need at least, and one for each piece of over half a
sequence. Each round is written to the shared folder; the driver sees only totals, until at most ``LAST_PIECES`` pieces and ``LAST_GAPS`` runs of gaps are
left, which is few whatever the input: it gives each of these its best fit, longest first. The rounds yield
runs of (length, ranks, sequences, offset), and a join by length and block of ranks gives every piece its place.

Cases: a null text is an empty one; a document without ids gives no piece; null ids are packed like others; rows
that share an id are packed each; equal rows take places in some order among themselves; a very long text is cut into full pieces; further columns
are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, running, small_batches, tidy
from .tokens import encode_documents

CAPACITY = 1024
#: Ranks that one key of the final join spans.
RANK_BLOCK = 4096
#: Pieces, and runs of gaps, up to which the driver places what is left itself, one by one.
LAST_PIECES, LAST_GAPS = 5_000, 50_000

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: full ones, before them a shorter one if the length asks for it."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of whole documents, with a checksum of their ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for i, ids in zip(b.column("id").to_pylist(), encode_documents(tokenizer, b.column("text").to_pylist(), end_id)):
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at += n
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(scan, keep_encoder=True), PIECES)


def _before(value: Column, part: str, order: Column) -> Column:
    """Sum of ``value`` over the earlier rows of the same ``part``."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def matched(todo: DataFrame, gaps: DataFrame) -> DataFrame:
    """(length, size, units): how many gaps of a size take a piece of a length. At most one row for each length and size."""
    pieces_ = todo.filter("left_ > 0").select(F.col("length").alias("at"), F.col("left_").alias("n"), F.lit(0).alias("kind"))
    line = pieces_.union(gaps.groupBy(F.col("size").alias("at")).agg(F.sum("n").alias("n")).select("at", "n", F.lit(1).alias("kind")))
    # at most two rows for each length up to the capacity, whatever the input: one task sorts them
    order = Window.orderBy("at", "kind")
    line = line.coalesce(1).withColumn("place", F.row_number().over(order)).withColumn("sum",
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(order))
    line = line.withColumn("open", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order))).withColumn("was", F.lag("open", 1, 0).over(order))
    top = F.greatest("open", "was")
    spans = line.select("at", "kind", "place", F.least("open", "was").alias("lo"), top.alias("hi")).filter("hi > lo")
    # levels between neighbouring bounds are alike
    bounds = spans.select(F.explode(F.array("lo", "hi")).alias("bound")).distinct()
    every = Window.orderBy("bound")
    bounds = bounds.select("bound", F.row_number().over(every).alias("i"), (F.lead("bound").over(every) - F.col("bound")).alias("units"))
    ends = bounds.select(F.col("bound").alias("hi"), F.col("i").alias("end"))
    levels = spans.join(bounds.select(F.col("bound").alias("lo"), F.col("i").alias("first")), "lo").join(ends, "hi")
    levels = levels.select("at", "kind", "place", F.explode(F.sequence("first", F.col("end") - 1)).alias("i")).join(bounds.select("i", "units"), "i")
    here = Window.partitionBy("i").orderBy("place")
    met = levels.withColumn("length", F.lag("at").over(here)).withColumn("other", F.lag("kind").over(here)).filter("kind = 1 and other = 0")
    return met.groupBy("length", F.col("at").alias("size")).agg(F.sum("units").alias("units"))


def one_round(todo: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """New runs, gaps and pieces left, told apart by ``kind``, from ``todo`` (length, taken, left_) and ``gaps`` (size, first, n)."""
    met = cut(matched(todo, gaps), "matched").join(F.broadcast(todo), "length")
    enough = F.floor(F.col("left_") / F.sum("units").over(Window.partitionBy("length")))
    met = met.withColumn("copies", F.least(F.floor(F.col("size") / F.col("length")), enough).cast("long"))
    met = met.withColumn("rank", F.col("taken") + _before(F.col("units") * F.col("copies"), "length", F.col("size")))
    met = met.select("size", "length", "units", "copies", "rank").withColumn("from_", _before(F.col("units"), "size", F.desc("length")))
    held = gaps.withColumn("begin", _before(F.col("n"), "size", F.col("first")))
    lo, hi = F.greatest("from_", "begin"), F.least(F.col("from_") + F.col("units"), F.col("begin") + F.col("n"))
    cuts = met.join(held, "size").select("size", "length", "units", "copies", "rank", (lo - F.col("from_")).alias("skip"),
        (F.col("first") + lo - F.col("begin")).alias("seq"), (hi - lo).alias("k")).filter("k > 0")
    row = lambda kind, *v: F.struct(F.lit(kind).alias("kind"), *[(F.lit(None) if i >= len(v) else v[i]).cast("long").alias(c) for i, c in enumerate("abcde")])
    runs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda j: row("run", F.col("length"),
        F.col("rank") + j * F.col("units") + F.col("skip"), F.col("k"), F.col("seq"), F.lit(capacity) - F.col("size") + j * F.col("length")))
    after = row("gap", F.col("size") - F.col("copies") * F.col("length"), F.col("seq"), F.col("k"))
    new = cuts.select(F.inline(F.concat(F.array(after), runs))).filter("kind = 'run' or a > 0")
    # of a gap run, what lies behind all units that its size gives away stays as it is
    given = met.groupBy("size").agg(F.sum("units").alias("m"))
    over = F.greatest(F.coalesce("m", F.lit(0)) - F.col("begin"), F.lit(0))
    stay = held.join(given, "size", "left").select(F.inline(F.array(row("gap", F.col("size"), F.col("first") + over, F.col("n") - over)))).filter("c > 0")
    used = met.groupBy("length").agg(F.sum(F.col("units") * F.col("copies")).alias("used"))
    gone = F.coalesce("used", F.lit(0))
    left = todo.join(used, "length", "left").select(F.inline(F.array(row("todo", F.col("length"), F.col("taken") + gone,
        F.col("left_") - gone)))).filter("c > 0")
    return new.union(stay).union(left)


def last_runs(rows: list, opened: int, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of one piece each that place the last pieces: each in the smallest gap that fits, longest first, a new sequence where none does.

    ``rows`` (kind, a, b, c): pieces left as (length, first rank, number) and gaps as (size, first sequence, number).
    """
    gaps: dict[int, list[list[int]]] = {}  # runs of gaps by size: first sequence and number
    for _, size, first, n in (r for r in rows if r[0] == "gap" and r[3] > 0):
        gaps.setdefault(size, []).append([first, n])
    sizes, out = sorted(gaps), []

    def put(size: int, seq: int) -> None:
        if size:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append([seq, 1])

    for _, length, first, n in sorted((r for r in rows if r[0] == "todo" and r[3] > 0), key=lambda r: -r[1]):
        for rank in range(first, first + n):
            at = bisect_left(sizes, length)
            if at == len(sizes):
                size, seq, opened = capacity, opened, opened + 1
            else:
                size = sizes[at]
                run = gaps[size][-1]
                seq = run[0]
                run[0], run[1] = run[0] + 1, run[1] - 1
                if not run[1]:
                    gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            out.append((length, rank, 1, seq, capacity - size))
            put(size - length, seq)
    return out


@contextmanager
def interpreted(spark: SparkSession) -> Iterator[None]:
    """Plans made inside are run without compiling each stage: a round's tables are tiny, and its many stages' code would fill the driver's memory."""
    name = "spark.sql.codegen.wholeStage"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def rounds(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Runs (run_length, first_rank, n, first_sequence, offset) that place all pieces. ``counts`` has ``length`` and ``n``."""
    first = cut(counts.select("length", "n"), "counts")  # at most one row a length; the pieces behind them are counted as compiled code
    with interpreted(counts.sparkSession):
        return _rounds(first, capacity)


def _rounds(counts: DataFrame, capacity: int) -> DataFrame:
    spark = counts.sparkSession
    rows = counts.coalesce(1).select(F.lit("todo").alias("kind"), F.col("length").cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
        F.col("n").cast("long").alias("c"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("e"))
    state, opened, placed = cut(rows, "round"), 0, []
    while True:
        left = F.when(F.col("kind") == "todo", F.col("c"))
        total = state.agg(
            F.sum(left * F.col("a")).alias("tokens"), F.sum(F.when(2 * F.col("a") > capacity, left)).alias("large"),
                F.min(F.when(left > 0, F.col("a"))).alias("shortest"),
            F.max(F.when(left > 0, F.col("a"))).alias("longest"), F.max(F.when(F.col("kind") == "gap", F.col("a"))).alias("gap"),
            F.coalesce(F.sum(left), F.lit(0)).alias("pieces"), F.count_if(F.col("kind") == "gap").alias("runs"),
        ).first()
        if not total.tokens:
            break
        if total.longest > capacity or total.shortest < 1:
            raise ValueError(f"pieces of {total.longest} ids don't fit")
        if placed and total.pieces <= LAST_PIECES and total.runs <= LAST_GAPS:
            last = state.filter("kind in ('todo', 'gap')").select("kind", "a", "b", "c").collect()
            placed.append(spark.createDataFrame(last_runs(last, opened, capacity), "a long, b long, c long, d long, e long"))
            break
        todo = state.filter("kind = 'todo'").select(F.col("a").alias("length"), F.col("b").alias("taken"), F.col("c").alias("left_"))
        gaps = state.filter("kind = 'gap'").select(F.col("a").alias("size"), F.col("b").alias("first"), F.col("c").alias("n"))
        if (total.gap or 0) < total.shortest:
            fresh = max(-(-total.tokens // capacity), total.large or 0)
            gaps = gaps.union(spark.range(1).select(F.lit(capacity).cast("long"), F.lit(opened).cast("long"), F.lit(fresh).cast("long")))
            opened += fresh
        state = cut(one_round(todo, gaps, capacity), "round")
        placed.append(state.filter("kind = 'run'").select(*"abcde"))
    schema = "run_length long, first_rank long, n long, first_sequence long, offset long"
    if not placed:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.union, placed).select(*[F.col(x).alias(y.split()[0]) for x, y in zip("abcde", schema.split(", "))])


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``id``, ``piece`` and ``length``."""
    ranked = running(parts, ["id", "piece", "start", "ids_crc32"], ["length"], label="pieces")
    placed = rounds(ranked.groupBy("length").agg((F.max("rank") + 1).alias("n")), capacity)
    block = F.explode(F.sequence((F.col("first_rank") / RANK_BLOCK).cast("long"), ((F.col("first_rank") + F.col("n") - 1) / RANK_BLOCK).cast("long")))
    placed = placed.withColumn("block", block)
    mine = (F.col("run_length") == F.col("length")) & (F.col("block") == F.floor(F.col("rank") / RANK_BLOCK))
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    out = ranked.join(placed, mine & inside)
    return out.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank")).select(*parts.columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None,
    capacity: int = CAPACITY) -> DataFrame:
    """doc id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    # written before they are range-sorted, since sorting samples its input and would encode the texts twice
    parts = cut(pieces(df, tokenizer, id_col, text_col, end_id, capacity), "pieces")
    return pack(parts, capacity).withColumnRenamed("id", id_col)
