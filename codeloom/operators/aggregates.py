"""Counts, audits and risk over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import risk_level
from .lineage import shuffled, sized

UNCATEGORISED = "(uncategorized)"


def category_counts(df: DataFrame, category: str) -> DataFrame:
    """Rows per category; null counts as ``(uncategorized)``."""
    return df.groupBy(F.coalesce(F.col(category), F.lit(UNCATEGORISED)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def coverage_diff(df: DataFrame, category: str, here: Column) -> DataFrame:
    """Per category: rows that meet ``here``, rows in scope, and how many are elsewhere.

    One aggregate gives what a full outer join of two would; ``elsewhere`` is never negative.
    """
    c = F.coalesce(F.col(category), F.lit(UNCATEGORISED)).alias("category")
    both = df.groupBy(c).agg(F.count_if(F.coalesce(here, F.lit(False))).alias("here"), F.count(F.lit(1)).alias("total"))
    return both.withColumn("elsewhere", F.greatest(F.col("total") - F.col("here"), F.lit(0)))


def outer_coverage(here: DataFrame, total: DataFrame) -> DataFrame:
    """The same from two counted tables (category, n)."""
    a, b = here.select("category", F.col("n").alias("_here")), total.select("category", F.col("n").alias("_total"))
    j = a.join(b, "category", "full")
    out = j.select("category", F.coalesce("_here", F.lit(0)).alias("here"), F.coalesce("_total", F.lit(0)).alias("total"))
    return out.withColumn("elsewhere", F.greatest(F.col("total") - F.col("here"), F.lit(0)))


def overridden(methods: DataFrame, keys: list[str], module: str, least: int = 2) -> DataFrame:
    """Groups declared by at least ``least`` modules."""
    return methods.groupBy(*keys).agg(F.count_distinct(module).alias("modules")).filter(F.col("modules") >= least)


def zero_coverage(items: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Items that nothing covers."""
    return items.join(covered.select(key), key, "left_anti")


def super_ratio(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Share of rows whose flag is true; null flags count as false."""
    on = F.sum(F.coalesce(flag, F.lit(False)).cast("int"))
    return df.groupBy(*keys).agg(on.alias("n_super"), F.count(F.lit(1)).alias("n")).withColumn("ratio", F.col("n_super") / F.col("n"))


def impact(entities: DataFrame, key: str, *counted: tuple[str, DataFrame]) -> DataFrame:
    """Correlated counts of each entity in several tables, their sum and its risk level.

    Every table is aggregated by key before the join, so the joins don't multiply rows.
    """
    out = entities.select(key).distinct()
    total = F.lit(0).cast("bigint")
    for name, df in counted:
        out = out.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
        total = total + F.col(name)
    return out.withColumn("score", total).withColumn("severity", risk_level(F.col("score")))


def quota(used: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """used, quota, remaining (not below 0) and percent with one digit, half to even; unlimited (null) quota has null rest."""
    j = plans.join(used, key, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    left = F.when(F.col("quota").isNotNull(), F.greatest(F.col("quota") - F.col("used"), F.lit(0)))
    return j.select(key, "quota", "used", left.alias("remaining"), F.when(F.col("quota") > 0,
        F.bround(100.0 * F.col("used") / F.col("quota"), 1)).alias("percent"))


def legacy_count(df: DataFrame, keys: list[str], prop: str) -> DataFrame:
    """How many rows of a group lack a property that old data doesn't have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(prop).isNull(), 1)).alias("legacy"))


def merged_properties(df: DataFrame, keys: list[str], array: str, flag: str, value: str, order: str) -> DataFrame:
    """Union of arrays, OR of flags, first non-null value in order."""
    first = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
    return df.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(array)))).alias(array), F.bool_or(flag).alias(flag), first.alias(value))


def top_models(models: DataFrame, depends: DataFrame, most: int = 100, rows: int | None = None) -> DataFrame:
    """(version, place, model, module, dependents): of each version the models whose defining modules most others depend on.

    ``models``: model, module, version, is_definition; ``depends``: src, dst, version. A version none of whose models is known as a definition lists all
    its models. Ties follow the model's and the module's name. Where ``models`` is dealt by module and version for so many ``rows``, the rest is dealt alike.
    """
    counts = depends.select("src", F.col("dst").alias("module"), "version").distinct().groupBy("module", "version").agg(F.count(F.lit(1)).alias("dependents"))
    if rows is not None:
        counts = sized(counts, rows, "module", "version")
    known = models.filter("version is not null").withColumn("_defined", F.coalesce("is_definition", F.lit(False))).join(shuffled(counts), ["module", "version"], "left").fillna(0, ["dependents"])
    # definitions and the rest are ranked apart; ranks are compared with ``most`` as they are, so that Spark keeps so many of each task before the last shuffle
    order = Window.partitionBy("version", "_defined").orderBy(F.desc("dependents"), "model", "module")
    first = known.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most)
    first = first.withColumn("_any", F.bool_or("_defined").over(Window.partitionBy("version"))).filter(F.col("_defined") | ~F.col("_any"))
    return first.select("version", (F.col("_rn") - 1).alias("place"), "model", "module", "dependents")
