"""Exact filtered vector search with rerank, literal and lexical search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, escape_like, ilike_literal
from ..functions.text import STOPWORDS

#: Weight of dependents, bonus of the context's closure, score of the first literal hit.
CENTRALITY, CLOSURE_BONUS, LITERAL_FLOOR, LITERAL_STEP = 0.02, 0.20, 2.0, 1e-6


def top_k(df: DataFrame, query: Sequence[float], k: int, vec: str = "embedding", key: str = "id") -> DataFrame:
    """The k nearest by cosine, exact; ties by key. The query vector is a literal and each task keeps its own k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("cosine", cosine(F.col(vec), q)).orderBy(F.desc("cosine"), F.asc(key)).limit(k)


def rerank(hits: DataFrame, dependents: DataFrame, near: DataFrame, module: str = "module") -> DataFrame:
    """cosine * (1 + w ln(dependents + 1)), and a bonus for modules in the context's dependency closure."""
    d = dependents.select(module, F.col("dependents").alias("_d"))
    n = near.select(module).distinct().withColumn("_near", F.lit(True))
    j = hits.join(d, module, "left").join(n, module, "left")
    score = F.col("cosine") * (1 + CENTRALITY * F.log1p(F.coalesce("_d", F.lit(0)).cast("double"))) + F.when(F.col("_near"), CLOSURE_BONUS).otherwise(0.0)
    return j.withColumn("score", score).drop("_d", "_near")


def literal_lookup(df: DataFrame, part: str, k: int, content: str, order: list[Column]) -> DataFrame:
    """Rows that hold ``part`` as it stands, in any case; shortest content first, then ``order``."""
    return df.filter(ilike_literal(F.col(content), part)).orderBy(F.length(content), *order).limit(k)


def lexical(df: DataFrame, keywords: Sequence[str], k: int, name: str, order: list[Column]) -> DataFrame:
    """Rows whose name holds any keyword; shortest name first, then ``order``. No keywords give no rows."""
    hit = F.lit(False)
    for w in keywords:
        hit = hit | F.col(name).ilike(f"%{escape_like(w)}%")
    return df.filter(hit).orderBy(F.length(name), *order).limit(k)


def merge_literal_first(literal: DataFrame, semantic: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Literal hits by their place (``place`` from 0) above all semantic ones, one row a key, cut to k.

    Both have the keys; ``semantic`` has ``score``. Literal hits score ``LITERAL_FLOOR`` and a little more the earlier they are.
    """
    n = literal.agg(F.count(F.lit(1)).alias("n")).scalar()
    a = literal.select(*keys, (LITERAL_FLOOR + (n - F.col("place")) * LITERAL_STEP).alias("score"), F.lit("literal").alias("match"))
    b = semantic.select(*keys, "score", F.lit("semantic").alias("match"))
    best = a.unionByName(b).groupBy(*keys).agg(F.max_by(F.struct("score", "match"), F.struct("score", "match")).alias("b"))
    return best.select(*keys, "b.score", "b.match").orderBy(F.desc("score"), *keys).limit(k)


def pattern_search(df: DataFrame, query: Sequence[float], limit: int, category: Column | None, version: Column | None, vec: str = "embedding",
    key: str = "id") -> DataFrame:
    """Over-fetch max(4 * limit, 20), then the category, then the version window, then the cut: in this order."""
    hits = top_k(df, query, max(4 * limit, 20), vec, key)
    for condition in (category, version):
        hits = hits if condition is None else hits.filter(condition)
    return hits.orderBy(F.desc("cosine"), F.asc(key)).limit(limit)


def extract_keywords(text: str) -> list[str]:
    """The driver's side of ``functions.text.keywords`` for one query text."""
    import re

    out: dict[str, None] = {}
    for w in re.split(r"[^\w.]+", text.lower()):
        w = w.strip(".")
        if len(w) >= 3 and w not in STOPWORDS:
            out[w] = None
    return list(out)


def one_space(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Sizes of the vectors in a table; a sound table has one row. Unlike a sample, it sees mixed tables."""
    return df.groupBy(F.size(vec).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
