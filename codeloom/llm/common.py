"""Helpers that several operators share: written tables, ordered prefix sums, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local session (one machine) gets a temporary folder of its own; on a cluster that would lie on machines' own disks, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/codeloom/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(df: DataFrame) -> None:
    """Delete the written table behind ``df``, which nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_order(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def running(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), weight: str | None = None, label: str = "running") -> DataFrame:
    """Add ``rank`` (0-based place in its group) and, with ``weight``, ``before`` (sum of weights of earlier rows).

    The rows are range-sorted by (group, order) and written once. Places inside a written partition come
    from a window over that partition alone; what earlier partitions hold comes from one row per
    (partition, group). So no task ever holds a whole group, however large the group is. Rows that tie in
    ``order`` take some order among themselves, fixed by the written table.
    """
    keys = [*group, *order]
    placed = df.repartitionByRange(*in_order(keys)).sortWithinPartitions(*in_order(keys))
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), label)
    inside = Window.partitionBy("_part", *group).orderBy("_at")
    local = placed.withColumn("_n", F.row_number().over(inside).cast("long") - 1)
    sums = [F.count(F.lit(1)).alias("_rows")]
    if weight:
        local = local.withColumn("_w", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
        sums.append(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *group).agg(*sums)
    heads = totals.withColumn("_rows0", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if weight:
        heads = heads.withColumn("_sum0", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    names = [f"_g{i}" for i in range(len(group))]
    heads = heads.drop("_rows").withColumnRenamed("_part", "_hpart").withColumnsRenamed(dict(zip(group, names)))
    on = F.col("_part") == F.col("_hpart")
    for g, n in zip(group, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    out = local.join(heads, on).withColumn("rank", F.col("_n") + F.col("_rows0"))
    if weight:
        out = out.withColumn("before", (F.col("_w") + F.col("_sum0")).cast("long"))
    return out.drop("_part", "_at", "_n", "_rows0", "_hpart", "_w", "_sum0", *names)


def without(df: DataFrame, gone: DataFrame, keys: Sequence[Column], hint: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``keys`` are no row of ``gone``, column by column; ``df`` may have any names. With ``hint``, ``gone`` is broadcast."""
    taken = {c.lower() for c in df.columns}
    names: list[str] = []
    for i in range(len(gone.columns)):
        name = f"_gone{i}"
        while name in taken:
            name += "_"
        names.append(name)
    gone = gone.toDF(*names)
    on = keys[0] == F.col(names[0])
    for key, name in zip(keys[1:], names[1:]):
        on = on & (key == F.col(name))
    return df.join(F.broadcast(gone) if hint else gone, on, "left_anti")


#: Tasks that the rows of one key may be dealt over.
SALTS = 1024


def spread_join(rows: DataFrame, side: DataFrame, on: str, by: str) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each value of ``on``; a hot value's rows are dealt over ``SALTS`` keys.

    ``by`` tells rows of one value apart. A value's row of ``side`` is repeated only for the salts that its rows have, so a
    value with few rows costs no more rows than it has. Null values meet nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    keys = salted.select(on, "_salt").distinct()
    return salted.join(keys.join(side, on), [on, "_salt"]).drop("_salt")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to few rows, so that very long texts don't pile up in a Python worker."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(values: list[str | None]) -> list[bytes]:
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]


def trim() -> None:
    """Return freed memory to the system. Python workers outlive their tasks, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim:
        malloc_trim(0)


def give_back() -> None:
    """``trim`` once cycles of objects are freed."""
    gc.collect()
    trim()


def free_encoder() -> None:
    """Free the tokenizer that this process holds, if any."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        give_back()


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(scan: Scan, keep_encoder: bool = False) -> Scan:
    """A task's function that gives memory back at its end.

    A worker's tokenizer and its memo take some 80 MB. Tasks that encode keep them for the next one; any other task finds
    a worker whose encoding is over, and frees them first.
    """

    @wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_encoder:
            free_encoder()
        yield from scan(batches)
        give_back()

    return run
