"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """``spark.checkpoint.dir``, else what the context was given.

    Where neither is set, a local session gets a temporary folder; on a cluster that would be machines' own disks, so
    it is an error there.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_folder(df: DataFrame) -> str:
    """A new folder in the shared one, removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(df)}/codeloom/{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once and survives lost executors."""
    path = fresh_folder(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all tasks of a shuffle, however small it is: for work that costs far more than its rows' bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that one task of a sized shuffle sorts or hashes.
TASK_ROWS = 500_000


def sized(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as ``rows`` rows need, so that a task's memory doesn't grow with the input.

    What follows by these keys needs no other shuffle. Rows are counted, since Spark joins partitions by their compressed bytes, which tell little of what is made of them.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never gathered in the driver to be broadcast.

    Spark guesses the size of derived tables from the bytes of their files, which is far too little where rows are made from a few small columns.
    """
    return df.hint("merge")


class Growing:
    """A table that grows by written parts; all parts are read as one, so plans don't grow with their number."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.folder, self.paths = first.sparkSession, first.schema, fresh_folder(first), []
        self.add(first)

    def add(self, part: DataFrame) -> bool:
        """Write a part; tells whether it has rows."""
        path = f"{self.folder}/{len(self.paths)}"
        part.write.parquet(path)
        self.paths.append(path)
        return not self.last().isEmpty()

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
