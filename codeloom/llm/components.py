"""Connected components of an edge table by alternating star contractions, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: More rounds than any input should need; the rounds shrink depth by a constant factor.
MAX_ROUNDS = 60


def _least(pairs: DataFrame, at: str, other: str) -> DataFrame:
    """For each node in ``at``, the least of itself and its partners in ``other``."""
    return pairs.groupBy(at).agg(F.least(F.first(at), F.min(other)).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return spread_join(both, _least(both, "u", "v"), "u", "v").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them. ``edges`` run from larger to smaller."""
    least = _least(edges, "u", "v")
    down = spread_join(edges, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return down.union(own).filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (any order, 64-bit) to ``node``, ``root``: each node that has an edge, and the least node it reaches.

    A round aggregates and joins by node and is written to the shared folder. No node's neighbours are gathered in
    one value or one task: minima are combined before the shuffle, and a hub's rows are dealt over many keys. Repeated edges and loops are harmless; an edge with a null
    end is dropped; no edges give no rows.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now = cut(now, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        now = cut(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
