"""An inverted-list vector index: approximate search over the nearest lists, and filtered search that widens until it is exact.

Directions of a bounded sample are clustered; every row goes to the list of its nearest centroid, and the index is a
table partitioned by list, so a probe of some lists reads their files alone. Each list's radius (the greatest
angle of a row to the centroid) bounds from below how near the list can come to a query: no row of a list is nearer than
the centroid's angle less the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, dot
from .lineage import cut, fresh_folder

#: Rows that centroids are fitted on, at most, and rounds of the fit.
SAMPLE_ROWS, FIT_ROUNDS = 20_000, 12
#: Rows of a list that one task writes; larger lists are dealt over several files.
LIST_ROWS = 500_000
#: Queries that are sent to every task at once, at most; more of them are dealt into blocks of about half as many.
QUERY_BLOCK = 4096
#: Rows and queries whose products are held at once.
TILE_ROWS, TILE_QUERIES = 1024, 256
#: Angles err by far less than this in doubles.
ANGLE_SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means, started from rows drawn without replacement. Empty ones keep their place."""
    x = _unit(sample.astype(np.float64))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where((np.linalg.norm(sums, axis=1) > 0)[:, None], _unit(sums), c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


@dataclass
class Index:
    """A written index: ``folder`` with rows by list, its centroids, and (list, radius, rows) of each list."""

    spark: SparkSession
    folder: str
    schema: object
    centroids: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    key: str
    vec: str

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The index's rows; with ``lists``, the files of those alone (a partition filter)."""
        df = self.spark.read.schema(self.schema).parquet(self.folder)
        return df if lists is None else df.filter(F.col("list").isin([int(x) for x in lists]))


def has_direction(vec: str) -> Column:
    """Whether a vector has a cosine at all: set, all components finite, and not zero."""
    far = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < far))
    return F.coalesce(F.col(vec).isNotNull() & fine & (dot(F.col(vec), F.col(vec)) > 0), F.lit(False))


def build_index(df: DataFrame, lists: int, key: str = "id", vec: str = "embedding", sample_rows: int = SAMPLE_ROWS, folder: str | None = None) -> Index:
    """Index every row of ``df`` that has a direction; all columns are kept. Rows without one match no query and are left out.

    The sample is the ``sample_rows`` rows with the least hashes of ``key``: bounded, and the same in every run.
    """
    good = df.filter(has_direction(vec))
    drawn = good.orderBy(F.xxhash64(key), key).limit(sample_rows).select(vec).toPandas()[vec]
    folder = folder or fresh_folder(df)
    if not len(drawn):
        schema = good.withColumn("list", F.lit(0)).schema
        good.limit(0).withColumn("list", F.lit(0)).write.parquet(folder)
        return Index(df.sparkSession, folder, schema, np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64), key, vec)
    centroids = fit_centroids(np.stack([np.asarray(v, np.float64) for v in drawn]), lists)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema) + ", list int, angle double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosines = _unit(_matrix(b.column(b.schema.get_field_index(vec)))) @ centroids.T
            near = cosines.argmax(1)
            angle = np.arccos(np.clip(cosines[np.arange(len(near)), near], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(angle)], [*b.schema.names, "list", "angle"])

    placed = cut(good.mapInArrow(assign, schema))
    stats = placed.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # one row a list
    radius, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in stats:
        radius[r.list], sizes[r.list] = r.radius, r.n
    # a large list is dealt over several tasks, a small one is one file
    parts = F.element_at(F.array(*[F.lit(int(-(-n // LIST_ROWS)) or 1) for n in sizes]), F.col("list") + 1)
    rows = placed.drop("angle").withColumn("_deal", F.pmod(F.xxhash64(key), parts))
    rows.repartition("list", "_deal").drop("_deal").write.partitionBy("list").parquet(folder)
    return Index(df.sparkSession, folder, placed.drop("angle").schema, centroids, radius, sizes, key, vec)


def _probe(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, k: int, key: str, vec: str) -> DataFrame:
    """(query, key, vec): each task's k nearest of each query among the rows of the lists that the query wants.

    ``wanted`` (queries, lists) says which. Scores are doubles of matrix products; the final order is settled by ``_best``.
    A task keeps a few more than k where scores are too near to tell apart.
    """
    unit = _unit(vectors)
    kind = rows.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in (whole.slice(at, TILE_ROWS) for whole in batches for at in range(0, whole.num_rows, TILE_ROWS)):
            lists = b.column("list").to_numpy()
            x = _unit(_matrix(b.column(vec)))
            keys = b.column(key).to_numpy(zero_copy_only=False)
            for at, asks in ((at, every[i : i + TILE_QUERIES]) for at in np.unique(lists) for every in [np.flatnonzero(wanted[:, at])] for i in range(0, len(every), TILE_QUERIES)):
                mine = np.flatnonzero(lists == at)
                scores = x[mine] @ unit[asks].T
                for j, q in enumerate(asks):
                    s, i = scores[:, j], keys[mine]
                    if q in held:
                        s, i = np.concatenate([held[q][0], s]), np.concatenate([held[q][1], i])
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k] - ANGLE_SLACK
                        s, i = s[s >= least], i[s >= least]
                    held[q] = s.copy(), i.copy()  # a view would keep the whole tile
        for q, (s, i) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), ids[q])), pa.array(i), pa.array(s)], ["query", key, "score"])

    return rows.select("list", key, vec).mapInArrow(scan, f"query long, {key} {kind}, score double")


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _blocks(queries: DataFrame, id_col: str) -> list[DataFrame]:
    """``queries`` in parts of at most about ``QUERY_BLOCK`` rows, by a hash of their ids."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return [queries]
    parts = -(-2 * n // QUERY_BLOCK)
    return [queries.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == i) for i in range(parts)]


def _queries(queries: DataFrame, id_col: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one block."""
    held = queries.filter(has_direction(vec)).select(id_col, vec).toPandas()
    return held[id_col].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in held[vec]]) if len(held) else np.zeros((0, 1))


def search(index: Index, queries: DataFrame, k: int, probes: int, where: Column | None = None, id_col: str = "query", vec: str = "embedding") -> DataFrame:
    """(query, key, score, place): the k nearest among the ``probes`` lists nearest to each query; approximate."""
    if len(parts := _blocks(queries, id_col)) > 1:
        return reduce(DataFrame.unionByName, [search(index, q, k, probes, where, id_col, vec) for q in parts])
    ids, vectors = _queries(queries, id_col, vec)
    near = np.argsort(-(_unit(vectors) @ index.centroids.T), axis=1)[:, :probes] if len(ids) and len(index.centroids) else np.zeros((0, 0), int)
    wanted = np.zeros((len(ids), max(1, len(index.centroids))), bool)
    for q, lists in enumerate(near):
        wanted[q, lists] = True
    rows = index.rows(sorted(set(near.ravel().tolist())))
    rows = rows if where is None else rows.filter(where)
    return _best(_probe(rows, ids, vectors, wanted, k, index.key, index.vec), k, index.key)


def search_until_full(index: Index, queries: DataFrame, k: int, where: Column | None = None, first: int = 2, id_col: str = "query", vec: str = "embedding") -> tuple[DataFrame, list[int]]:
    """As ``search``, but a query's lists are probed in rounds until its answer is exact; also the number of queries open in each round.

    Lists come by their bound (centroid angle less radius), twice as many each round. A query is done when it has k rows that pass ``where`` and
    no list left can hold a nearer one, or when no list is left. What a query needs to know between rounds is its k-th score: one number.
    """
    if len(parts := _blocks(queries, id_col)) > 1:
        found = [search_until_full(index, q, k, where, first, id_col, vec) for q in parts]
        return reduce(DataFrame.unionByName, [f for f, _ in found]), [sum(n) for n in zip_longest(*(r for _, r in found), fillvalue=0)]
    ids, vectors = _queries(queries, id_col, vec)
    empty = index.rows([]).select(F.lit(0).cast("long").alias("query"), index.key, F.lit(0.0).alias("score"))
    if not len(ids) or not len(index.centroids):
        return _best(empty, k, index.key), []
    angle = np.arccos(np.clip(_unit(vectors) @ index.centroids.T, -1, 1))
    bound = np.where(index.sizes > 0, np.maximum(angle - index.radius, 0) - ANGLE_SLACK, np.inf)
    order = np.argsort(bound, axis=1, kind="stable")
    done, open_, width, at, rounds = empty, np.arange(len(ids)), first, 0, []
    while len(open_) and at < order.shape[1]:
        rounds.append(len(open_))
        wanted = np.zeros((len(open_), order.shape[1]), bool)
        np.put_along_axis(wanted, order[open_, at : at + width], True, axis=1)
        wanted &= index.sizes > 0
        rows = index.rows(np.flatnonzero(wanted.any(0)).tolist())
        rows = rows if where is None else rows.filter(where)
        fresh = _probe(rows, ids[open_], vectors[open_], wanted, k, index.key, index.vec)
        done = cut(_best(done.unionByName(fresh), k, index.key).drop("place"))
        at, width = at + width, width * 2
        kth = {r.query: r.s for r in done.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).collect()}
        if at < order.shape[1]:
            next_bound = bound[open_, order[open_, at]]
            farthest = np.array([np.arccos(np.clip(kth[i], -1, 1)) if i in kth else np.inf for i in ids[open_]])
            open_ = open_[(next_bound <= farthest) & np.isfinite(next_bound)]
    return _best(done, k, index.key), rounds


def exact(df: DataFrame, queries: DataFrame, k: int, key: str = "id", vec: str = "embedding") -> DataFrame:
    """(query, key, score, place) by every query against every row, for measuring recall: queries in a block sent to each task."""
    if len(parts := _blocks(queries, "query")) > 1:
        return reduce(DataFrame.unionByName, [exact(df, q, k, key, vec) for q in parts])
    ids, vectors = _queries(queries, "query", vec)
    rows = df.filter(has_direction(vec)).withColumn("list", F.lit(0))
    return _best(_probe(rows, ids, vectors, np.ones((len(ids), 1), bool), k, key, vec), k, key)


def probes_for(index: Index, queries: DataFrame, k: int, target: float = 0.95) -> int:
    """The least number of lists that finds the share ``target`` of the true k nearest of ``queries``.

    Each true neighbour lies in the list that is some place in its query's order of lists: the answer is a quantile of those places.
    """
    needed = np.sort(np.concatenate([_places(index, q, k) for q in _blocks(queries, "query")]))
    return int(needed[max(0, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else len(index.centroids)


def _places(index: Index, queries: DataFrame, k: int) -> np.ndarray:
    """In which place of its query's order of lists each true neighbour of a block of queries lies, from 1."""
    ids, vectors = _queries(queries, "query", "embedding")
    if not len(ids) or not len(index.centroids):
        return np.zeros(0, int)
    place = np.argsort(np.argsort(-(_unit(vectors) @ index.centroids.T), axis=1), axis=1)
    at = {q: i for i, q in enumerate(ids)}
    rows = index.rows()
    true = exact(rows.drop("list"), queries, k, index.key, index.vec).join(rows.select(index.key, "list"), index.key).select("query", "list").collect()  # k rows a query
    return np.array([place[at[r.query], r.list] + 1 for r in true], int)


def recall(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(query, hits, wanted): how many of the true neighbours were found."""
    hit = truth.select("query", key).join(found.select("query", key, F.lit(1).alias("_hit")), ["query", key], "left")
    return hit.groupBy("query").agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))


def rescored(found: DataFrame, rows: DataFrame, queries: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Hits with ``cosine`` computed by Spark's own expression."""
    a, b = rows.select(key, F.col(vec).alias("_a")), queries.select("query", F.col(vec).alias("_b"))
    return found.join(a, key).join(b, "query").withColumn("cosine", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
