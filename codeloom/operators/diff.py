"""Differences between versions, and unions of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_diff(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(key, bucket, successor): added, removed, replaced, deprecated or stable.

    Tables have (key, status, replaced_by), one row a key. Replaced: the old one vanished and its successor exists in the new
    version; with a dangling successor it is removed. Deprecated: in both, newly so.
    """
    a = old.select(F.col(key), F.lit(True).alias("_old"), F.col("status").alias("_s0"), F.col("replaced_by").alias("_r"))
    b = new.select(F.col(key), F.lit(True).alias("_new"), F.col("status").alias("_s1"))
    alive = new.select(F.col(key).alias("_r"), F.lit(True).alias("_alive")).distinct()
    j = a.join(b, key, "full").join(alive, "_r", "left")
    gone = F.col("_new").isNull()
    bucket = (
        F.when(F.col("_old").isNull(), "added").when(gone & F.col("_alive").isNotNull(), "replaced").when(gone, "removed")
        .when((F.col("_s1") == "deprecated") & ~(F.coalesce("_s0", F.lit("")) == "deprecated"), "deprecated").otherwise("stable")
    )
    return j.select(key, bucket.alias("bucket"), F.when(bucket == "replaced", F.col("_r")).alias("successor"))


def lifecycle(old: DataFrame, new: DataFrame, old_version: str, new_version: str, key: str = "name") -> DataFrame:
    """(key, version, added_in, removed_in, deprecated_in) of the rows that a diff marks."""
    d = version_diff(old, new, key)
    at = lambda b: F.when(F.col("bucket").isin(*b), F.lit(new_version))
    side = F.when(F.col("bucket").isin("removed", "replaced"), F.lit(old_version)).otherwise(F.lit(new_version))
    return d.filter(F.col("bucket") != "stable").select(key, side.alias("version"), at(["added"]).alias("added_in"),
        at(["removed", "replaced"]).alias("removed_in"), at(["deprecated"]).alias("deprecated_in"))


def flag_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer difference of (keys, value): added, removed, changed; equal rows are left out."""
    a, b = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_a")), new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_b"))
    j = a.join(b, keys, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return j.withColumn("change", change).filter(F.col("change").isNotNull()).select(*keys, "change", "old_value", "new_value")


def array_diff(df: DataFrame, old: str, new: str) -> DataFrame:
    """Sorted elements lost, gained and kept between two array columns."""
    kept = F.sort_array(F.array_intersect(old, new))
    return df.withColumns({"lost": F.sort_array(F.array_except(old, new)), "gained": F.sort_array(F.array_except(new, old)), "kept": kept})


def union_distinct(*legs: DataFrame) -> DataFrame:
    """UNION: the legs have the same columns."""
    return reduce(DataFrame.unionByName, legs).distinct()


def changed_modules(modules: DataFrame, paths: DataFrame) -> DataFrame:
    """Modules (name, root) that hold a changed path: the path begins with the module's folder.

    Paths are cut into all their leading folders, so the join is by equality.
    """
    parts = F.split("path", "/")
    tops = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return modules.join(paths.select(F.explode(tops).alias("root")).distinct(), "root", "left_semi")
