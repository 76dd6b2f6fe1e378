"""Source divergence audit: how far each source's terms lie from every other source's and from its language's.

Sort-based streaming. A task takes blocks of whole documents, orders their terms by (term, source, document) and scans
the runs: one partial row a (lang, term, source) with its document frequency and count. Partial rows are
repartitioned, sorted by (lang, term, source) and scanned again, run by run, by tasks that hold one run at a time.
Known totals then go ahead of the kept terms in the same sort order, and a last scan emits partial pair sums and
the best terms of each source.

A term that already has ``min_docs`` documents in one block is kept for certain. Its rows are dealt over ``SALTS``
shards by block, and a marker tells the shard of the term's other rows that the term stays; so a
frequent word never brings all its rows to one task, and no rare word takes a second shuffle. Pairs of sources are
cut in blocks of ``PAIR_SOURCES``, so a task's table of counts has a bounded width.

Cases: a null text, lang or source counts as ''; a document is a row, so rows that repeat an id are documents of their own;
empty and very long texts are taken whole; a (lang, source) without terms has its pairs, with value 0 where its language keeps no term; ties
in value follow the item's UTF-8 order; further columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

#: Terms that a task orders at once.
BLOCK_TERMS = 3_000_000
#: Shards of a term that is frequent within one block.
SALTS = 64
#: Sources on each side of a block of pairs.
PAIR_SOURCES = 256
#: Kept rows that one shard of the last scan takes, about.
SHARD_ROWS = 250_000
#: Cells of the table of counts that the last scan fills at once.
CELLS = 1 << 20
SCALE, PRIOR = 1_000_000_000, 5

#: Letters stay (A-Z in lower case), bytes of other code points stay, all else separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("salt", pa.int32()), ("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])
RUN_SQL = "lang string, term string, salt int, source string, df long, n long"


def _starts(*cols: pa.Array) -> np.ndarray:
    """Places where a new run of equal values begins."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _block_runs(docs: list[tuple[str, str, list[bytes]]], salt: int, min_docs: int) -> pa.RecordBatch:
    """Partial runs of a block: terms ordered by (term, lang, source, document), scanned once."""
    docs.sort(key=lambda d: d[:2])
    groups = sorted({d[:2] for d in docs})
    place = {g: i for i, g in enumerate(groups)}
    lengths = [len(d[2]) for d in docs]
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
    group_of = np.array([place[d[:2]] for d in docs], np.int32)
    every = np.empty(sum(lengths), object)
    every[:] = [t for d in docs for t in d[2]]
    codes, terms = pd.factorize(every)
    del every
    order = np.argsort(codes, kind="stable")  # documents come by (lang, source), so places in a term's run do too
    codes, doc = codes[order], doc[order]
    group = group_of[doc]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    df = np.add.reduceat(fresh.astype(np.int64), at)
    n = np.diff(np.append(at, len(codes)))
    codes, group = codes[at], group[at]
    langs, lang_of = np.unique([g[0] for g in groups], return_inverse=True)
    key = codes.astype(np.int64) * len(langs) + lang_of[group]
    _, run = np.unique(key, return_inverse=True)
    sure = np.bincount(run, df)[run] >= min_docs
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    marks = np.flatnonzero(sure & first)
    rows = np.concatenate([np.arange(len(key)), marks])
    salts = np.where(sure, np.int32(salt), np.int32(0))
    salts = np.concatenate([salts, np.zeros(len(marks), np.int32)])
    zero = np.zeros(len(marks), np.int64)
    text = lambda values, take: pa.array(values, pa.string()).take(pa.array(take))
    return pa.RecordBatch.from_arrays([
        text([g[0] for g in groups], group[rows]), pa.array(list(terms), pa.binary()).take(pa.array(codes[rows])).view(pa.string()), pa.array(salts),
        text([g[1] for g in groups], group[rows]), pa.array(np.concatenate([df, np.full(len(marks), min_docs)])), pa.array(np.concatenate([n, zero])),
    ], schema=RUN)


def partial_runs(docs: DataFrame, min_docs: int, salts: int, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Partial (lang, term, salt, source, df, n) of blocks of whole documents.

    A frequent term's marker has its least source, ``min_docs`` documents and no count: that is enough for its shard to keep the term.
    """

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, salt = [], 0, 0
        for b in batches:
            raw = b.column("text").cast(pa.binary())
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), raw):
                value = text.as_buffer()
                terms = bytes(value).translate(FOLD).split() if value else []
                if not terms:
                    continue
                if size + len(terms) > block_terms and held:
                    salt = hash((salt, size))
                    yield from _slices(_block_runs(held, 1 + salt % salts, min_docs))
                    held, size = [], 0
                held.append((lang, source, terms))
                size += len(terms)
        if held:
            yield from _slices(_block_runs(held, 1 + hash((salt, size)) % salts, min_docs))

    return docs.mapInArrow(scan, RUN_SQL)


def _slices(b: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _collapse(t: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Sorted partial rows to one row a (lang, term, salt, source), and the places where runs of (lang, term, salt) begin."""
    at = _starts(t.column("lang"), t.column("term"), t.column("salt"), t.column("source"))
    take = pa.array(at)
    sums = [pa.array(np.add.reduceat(t.column(c).to_numpy(), at)) for c in ("df", "n")]
    out = pa.RecordBatch.from_arrays([*(t.column(c).take(take) for c in RUN.names[:4]), *sums], schema=RUN)
    return out, _starts(out.column("lang"), out.column("term"), out.column("salt"))


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole collapsed runs of a sorted partition. The open run is carried on in collapsed form, one row a source."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays([b.column(c) for c in RUN.names], schema=RUN)
        t, starts = _collapse(pa.concat_batches([held, b]) if held is not None else b)
        if starts[-1]:
            yield t.slice(0, int(starts[-1])), starts[:-1]
        held = t.slice(int(starts[-1]))
    if held is not None:
        yield held, np.zeros(1, np.int64)


def term_counts(docs: DataFrame, min_docs: int = 30, salts: int = SALTS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, term, source, n, total, first) of the terms in at least ``min_docs`` documents of their language.

    ``total`` is the term's count in the language; ``first`` is 1 in one row a term. Only sources with the term have a row.
    """

    @tidy
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches):
            spans = np.diff(np.append(starts, t.num_rows))
            enough = np.add.reduceat(t.column("df").to_numpy(), starts) >= min_docs
            keep = np.repeat(enough, spans) | (t.column("salt").to_numpy() > 0)
            keep &= t.column("n").to_numpy() > 0
            yield from _slices(t.filter(pa.array(keep)))

    @tidy
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches):
            n = t.column("n").to_numpy()
            total = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, t.num_rows)))
            first = np.zeros(len(n), np.int32)
            first[starts] = 1
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("lang", "term", "source", "n")), pa.array(total), pa.array(first)],
                ["lang", "term", "source", "n", "total", "first"])

    parts = partial_runs(docs, min_docs, salts, block_terms)
    runs = parts.repartition("lang", "term", "salt").sortWithinPartitions("lang", "term", "salt", "source").mapInArrow(decide, RUN_SQL)
    merged = runs.withColumn("salt", F.lit(0)).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return merged.mapInArrow(settle, "lang string, term string, source string, n long, total long, first int")


def _share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole), exact for ``whole`` up to 2^53: the quotient's decimal digits, three at a time."""
    out, rest = count // whole, count % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


class _Unit:
    """What the last scan holds of one shard of one block of pairs: its sources, pair sums, best terms, and open rows."""

    def __init__(self, lang: str, mine: list[str], other: list[str], diagonal: bool, whole: np.ndarray, whole_lang: int, top: int):
        self.lang, self.mine, self.other, self.diagonal, self.top = lang, mine, other, diagonal, top
        self.names = mine + other
        self.place = pa.array(self.names)
        self.whole, self.whole_lang = whole, whole_lang
        self.sums = np.zeros((len(mine), len(mine) if diagonal else len(other)), np.int64)
        self.best = pd.DataFrame({"g": np.array([], np.int64), "value": np.array([], np.int64), "term": np.array([], object)})

    def add(self, term: pa.Array, source: pa.Array, n: np.ndarray, total: np.ndarray) -> None:
        """Rows of whole terms, in order."""
        starts = _starts(term)
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
        col = pc.index_in(source, self.place).to_numpy(zero_copy_only=False).astype(np.int64)
        step = max(1, CELLS // len(self.names))
        for at in range(0, len(starts), step):
            held = (row >= at) & (row < at + step)
            counts = np.zeros((min(step, len(starts) - at), len(self.names)), np.int64)
            counts[row[held] - at, col[held]] = n[held]
            p = _share(counts + PRIOR, self.whole[None, :])
            right = p if self.diagonal else p[:, len(self.mine):]
            for i in range(len(self.mine)):
                self.sums[i] += np.abs(right - p[:, i:i + 1]).sum(0)
        if self.diagonal:
            value = _share(n + PRIOR, self.whole[col]) - _share(total + PRIOR, np.full(len(n), self.whole_lang))
            more = value > 0
            fresh = pd.DataFrame({"g": col[more], "value": value[more], "term": term.filter(pa.array(more)).to_numpy(zero_copy_only=False)})
            both = pd.concat([self.best, fresh], ignore_index=True)  # earlier terms are less in UTF-8 order
            order = np.lexsort((np.arange(len(both)), -both["value"].to_numpy(), both["g"].to_numpy()))
            both = both.iloc[order]
            self.best = both[both.groupby("g", sort=False).cumcount() < self.top].reset_index(drop=True)

    def rows(self) -> Iterator[pa.RecordBatch]:
        make = lambda source, part, item, value: pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(item), pa.string()), source, pa.array([part] * len(item), pa.string()), item, pa.array(value)], ["lang", "source", "part", "item", "value"])
        right = self.mine if self.diagonal else self.other
        for i, name in enumerate(self.mine):
            items = pa.array(right, pa.string())
            same = pa.array([name] * len(right), pa.string())
            yield make(same, "pair", items, self.sums[i])
            if not self.diagonal:
                yield make(items, "pair", same, self.sums[i])
        if len(self.best):
            names = pa.array(self.mine, pa.string()).take(pa.array(self.best["g"].to_numpy(np.int64)))
            yield make(names, "term", pa.array(self.best["term"].tolist(), pa.string()), self.best["value"].to_numpy(np.int64))


def _partials(top: int):
    """The scan of units: a unit's sources come first (kind 0), then its terms in order."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "left", "right", "shard", "kind", "term", "source", "n", "total"]
        unit, open_key, heads, held = None, None, [], None

        def flush():
            nonlocal held
            if held is not None:
                unit.add(held[0], held[1], held[2].to_numpy(), held[3].to_numpy())
                held = None

        def begin():
            nonlocal unit, heads
            lang, left, right, _ = open_key
            mine = [h for h in heads if h[0] == left]
            other = [h for h in heads if h[0] != left]
            whole = np.array([h[2] for h in mine + other], np.int64)
            unit = _Unit(lang, [h[1] for h in mine], [h[1] for h in other], left == right, whole, heads[0][3], top)
            heads = []

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            edges = np.append(_starts(*cols[:5]), b.num_rows)
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                key = tuple(c[at].as_py() for c in cols[:4])
                part = [c.slice(at, end - at) for c in cols[5:]]
                if key != open_key:
                    if open_key is not None:
                        if heads:
                            begin()
                        flush()
                        yield from unit.rows()
                    open_key, unit = key, None
                if cols[4][at].as_py() == 0:
                    heads += list(zip([int(t) for t in part[0].to_pylist()], part[1].to_pylist(), part[2].to_pylist(), part[3].to_pylist()))
                    continue
                if heads:
                    begin()
                if held is not None:
                    part = [pa.concat_arrays([h, p]) for h, p in zip(held, part)]
                last = int(_starts(part[0])[-1])  # the last term may go on in the next batch
                if last:
                    unit.add(part[0].slice(0, last), part[1].slice(0, last), part[2].slice(0, last).to_numpy(), part[3].slice(0, last).to_numpy())
                held = [p.slice(last) for p in part]
        if open_key is not None:
            if heads:
                begin()
            flush()
            yield from unit.rows()

    return scan


def divergence(df: DataFrame, min_docs: int = 30, top: int = 50, salts: int = SALTS, pair_sources: int = PAIR_SOURCES, shard_rows: int = SHARD_ROWS,
               block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of a language's sources and the ``top`` terms of each source.

    A term's share in a group of N kept occurrences is 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), V terms kept. A pair's value
    is the sum of differences of shares over all kept terms, a term's the excess of the source's share over the language's.
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(term_counts(docs, min_docs, salts, block_terms), "terms")
    groups = docs.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"))
    heads = cut(groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "v"]), "groups")
    langs = heads.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("v").alias("v_lang"), F.count(F.lit(1)).alias("sources"))
    in_lang = Window.partitionBy("lang").orderBy("source")
    blocks = heads.withColumn("block", F.floor((F.row_number().over(in_lang) - 1) / pair_sources).cast("int")).join(langs, "lang")
    blocks = cut(blocks.withColumn("blocks", F.ceil(F.col("sources") / pair_sources).cast("int")), "blocks")
    shards = max(1, -(-counts.count() // shard_rows))
    # a source meets the blocks at and after its own as the left side, those before as the right side
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with_block")
    sided = lambda d: d.withColumn("left", F.least("block", "with_block")).withColumn("right", F.greatest("block", "with_block"))
    whole = lambda n, v: F.col(n) + PRIOR * F.col(v)
    header = sided(blocks.select("*", each)).select("lang", "left", "right", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"),
        F.col("block").cast("string").alias("term"), "source", F.greatest(whole("n", "v_lang"), F.lit(1)).alias("n"), F.greatest(whole("n_lang", "v_lang"), F.lit(1)).alias("total"))
    located = counts.join(blocks.select("lang", "source", "block", "blocks"), ["lang", "source"])
    rows = sided(located.select("*", each)).select("lang", "left", "right", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"),
        "term", "source", "n", "total")
    unit = ["lang", "left", "right", "shard"]
    found = header.unionByName(rows).repartition(*unit).sortWithinPartitions(*unit, "kind", "term", "source").mapInArrow(
        _partials(top), "lang string, source string, part string, item string, value long")
    pairs = found.filter("part = 'pair' and source <> item").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.unionByName(terms)
