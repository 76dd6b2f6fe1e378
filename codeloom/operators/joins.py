"""Join shapes over node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct (a, c) with a -> b in ``first`` and b -> c in ``second`` (columns ``src``, ``dst``)."""
    a = first.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    b = second.select(F.col("src").alias("b"), F.col("dst").alias("c")).distinct()
    return a.join(b, "b").select("a", "c").distinct()


def prefer(left: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``value`` from ``first``, else from ``second``; both have one row a key."""
    a = first.select(key, F.col(value).alias("_a"))
    b = second.select(key, F.col(value).alias("_b"))
    kind = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second")
    return left.join(a, key, "left").join(b, key, "left").select(*left.columns, F.coalesce("_a", "_b").alias(value), kind.alias("found_in"))


def counted(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Correlated count: rows of ``right`` for each row of ``left``, zero kept."""
    return left.join(right.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def in_list(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Rows whose value is in a literal list; an empty list gives no rows."""
    return df.filter(F.col(col).isin(*values)) if values else df.filter(F.lit(False))


def uncovered(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def exists_in(left: DataFrame, right: DataFrame, key: str, name: str = "found") -> DataFrame:
    """``left`` with whether ``right`` has a row of its key; many such rows count as one."""
    have = right.select(key).distinct().withColumn(name, F.lit(True))
    return left.join(have, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
