"""Sinks that write: tables of buckets behind a snapshot pointer, so that a reader sees the old table or the new one, never a part of either.

Rows lie in buckets by a hash of their scope. A commit writes the buckets that it changes into a new folder and then adds one
small file, the next pointer, which names every bucket's folder; that file is renamed into place and never overwritten, so
of two writers at once one fails and nothing of it is seen. A write that fails before leaves the table as it was. The pointer has
one entry a bucket, however many rows and scopes there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep_old_vectors, replace_partition, upsert


class WriteConflict(RuntimeError):
    """Another writer committed first; read again and repeat."""


class SnapshotTable:
    """A table under ``folder``, bucketed by ``scope`` columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, scope: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.scope, self.buckets = spark, folder.rstrip("/"), list(scope), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop

    # the pointer

    def _context(self):
        path = self._hadoop.fs.Path(self.folder)
        return self._hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 for a table without one."""
        path = self._hadoop.fs.Path(f"{self.folder}/pointers")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def parts(self, version: int | None = None) -> dict[str, str]:
        """Bucket to folder, as of a commit."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/pointers/{version}").first().value)

    def _point(self, version: int, parts: dict[str, str]) -> None:
        fs = self._hadoop.fs
        draft, final = fs.Path(f"{self.folder}/pointers/_{uuid.uuid4().hex}"), fs.Path(f"{self.folder}/pointers/{version}")
        system = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            self._context().rename(draft, final, keep)
        except Py4JJavaError as e:
            system.delete(draft, False)
            raise WriteConflict(f"commit {version} of {self.folder} exists") from e

    # reading and writing

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.scope), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows as of a commit (the last one by default); ``buckets`` reads the files of those alone."""
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.folder}/{p}" for b, p in sorted(self.parts(version).items()) if wanted is None or b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rewrite(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Commit ``change(old, new)`` over the buckets that ``new`` has rows in; all other buckets stay. Returns the commit's number.

        ``change`` must leave rows in their scopes. Without rows in ``new`` nothing is committed.
        """
        seen = self.version()
        new = new.select(*self.schema.names)
        touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())  # at most one row a bucket
        if not touched:
            return seen
        parts, fresh = self.parts(seen), f"parts/{uuid.uuid4().hex}"
        rows = change(self.read(seen, touched), new).select(*self.schema.names).withColumn("_bucket", self._bucket())
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{fresh}")
        path = self._hadoop.fs.Path(f"{self.folder}/{fresh}")
        names = {s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)}
        for b in touched:
            parts.pop(str(b), None)
            if f"_bucket={b}" in names:
                parts[str(b)] = f"{fresh}/_bucket={b}"
        self._point(seen + 1, parts)
        return seen + 1

    def vacuum(self, keep: int = 2) -> None:
        """Delete pointers older than the last ``keep`` commits and folders that none of these names."""
        last = self.version()
        held = {p.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for p in self.parts(v).values()}
        conf = self.spark._jsc.hadoopConfiguration()
        for kind, stays in (("pointers", {str(v) for v in range(max(1, last - keep + 1), last + 1)}), ("parts", held)):
            path = self._hadoop.fs.Path(f"{self.folder}/{kind}")
            fs = path.getFileSystem(conf)
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in stays:
                    fs.delete(s.getPath(), True)


def write_graph(table: SnapshotTable, rows: DataFrame, keys: Sequence[str], union_cols: Sequence[str] = (), or_cols: Sequence[str] = ()) -> int:
    """Graph sink: key-matched upsert; the table's scope must be among ``keys``. A repeated write changes nothing."""
    if not set(table.scope) <= set(keys):
        raise ValueError("a key must name its scope")
    return table.rewrite(rows, lambda old, new: upsert(old, new, keys, union_cols, or_cols))


def write_vectors(table: SnapshotTable, rows: DataFrame, vec: str, dedup: Sequence[str], order: str) -> int:
    """Vector sink: the scopes of ``rows`` are replaced, the last row of each ``dedup`` key wins.

    Scopes none of whose rows has a vector keep what they have: a failed embedding never wipes a module.
    """
    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        last = replace_partition(new.limit(0), new, table.scope, dedup, order)
        return keep_old_vectors(old, last, table.scope, vec)

    return table.rewrite(rows, change)
