"""Embedding in tasks, with a ladder of retries: a batch, the batch again, then chunk by chunk, so that one bad chunk costs only itself."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: texts sent to a backend at once.
BATCH = 50


class Backend(Protocol):
    """What embeds texts. ``model`` and ``dim`` name the vector space."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class DigestBackend:
    """A stand-in for tests: 16 components from the text's MD5 bytes, of unit length. Equal texts have equal vectors everywhere.

    As a real backend does, it refuses a whole call where a text is empty or longer than its window.
    """

    model, dim = "digest", 16

    def __init__(self, window: int = 8192):
        self.window = window

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any(not t or len(t) > self.window for t in texts):
            raise ValueError("a text is empty or beyond the window")
        out = []
        for t in texts:
            x = np.frombuffer(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), np.uint8) - 127.5
            out.append((x / np.sqrt((x * x).sum())).tolist())
        return out


def climb(backend: Backend, texts: list[str]) -> list[tuple[list[float] | None, str, str | None]]:
    """(vector, rung, error) of each text; rung: batch, again, single or failed. A call that returns a wrong number of vectors counts as failed."""
    error = None
    for rung in ("batch", "again"):
        try:
            vectors = backend.embed(texts)
            if len(vectors) != len(texts):
                raise ValueError("the backend returned another number of vectors")
            return [(v, rung, None) for v in vectors]
        except Exception as e:  # noqa: BLE001 - whatever a backend raises, the ladder goes on
            error = e
    out: list[tuple[list[float] | None, str, str | None]] = []
    for t in texts:
        try:
            [v] = backend.embed([t])
            out.append((v, "single", None))
        except Exception as e:  # noqa: BLE001
            out.append((None, "failed", str(e) or str(error)))
    return out


def embed_rows(chunks: DataFrame, backend: Callable[[], Backend], text: str = "content", batch: int = BATCH) -> DataFrame:
    """``chunks`` with embedding (array<float>), rung, error, model and dim. A null text counts as an empty one; no row is lost.

    A task makes its backend once and sends its rows in batches. A replayed task calls the backend again; rows don't change for that
    where the backend gives equal texts equal vectors.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = backend()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                found = climb(made, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array([v for v, _, _ in found], pa.list_(pa.float32())), pa.array([r for _, r, _ in found]), pa.array([e for _, _, e in found], pa.string()),
                    pa.array([made.model] * len(found)), pa.array([made.dim] * len(found), pa.int32()),
                ], [*part.schema.names, "embedding", "rung", "error", "model", "dim"])

    return chunks.mapInArrow(run, f"{schema}, embedding array<float>, rung string, error string, model string, dim int")


def outcomes(embedded: DataFrame, *scope: str) -> DataFrame:
    """Rows by scope: all, embedded, and failed; a scope without any vector keeps its old rows in the sink."""
    ok = F.col("embedding").isNotNull()
    return embedded.groupBy(*scope).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(ok).alias("embedded"), F.count_if(~ok).alias("failed"))


def foreign_space(table: DataFrame, model: str, dim: int) -> DataFrame:
    """(model, dim, n) of stored rows of another vector space than (``model``, ``dim``); a sound table gives no rows.

    Rows without a model are from before models were stored; their size alone is compared.
    """
    own = (F.size("embedding") == dim) & (F.col("model").isNull() | (F.col("model") == model))
    return table.filter(F.col("embedding").isNotNull() & ~own).groupBy("model", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
