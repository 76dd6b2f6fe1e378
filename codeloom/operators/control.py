"""Relational operators of the control plane: tenants, plans, settings, jobs, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import counted
from .ranking import first_by


def tenants_with_counts(tenants: DataFrame, key: str, *tables: tuple[str, DataFrame]) -> DataFrame:
    """A tenant's rows in each table; zero kept."""
    for name, df in tables:
        tenants = counted(tenants, df, key, name)
    return tenants


def resolve_setting(wanted: DataFrame, settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """``wanted`` (tenant, key): the tenant's value, else the system's (null tenant), else the default; a stored null falls through."""
    own = settings.filter(F.col("tenant").isNotNull()).select("tenant", "key", F.col("value").alias("_own"))
    system = settings.filter(F.col("tenant").isNull()).select("key", F.col("value").alias("_system"))
    j = wanted.join(own, ["tenant", "key"], "left").join(system, "key", "left").join(defaults.select("key", F.col("value").alias("_default")), "key", "left")
    return j.select("tenant", "key", F.coalesce("_own", "_system", "_default").alias("value"))


def effective_limit(override: Column, plan: Column) -> Column:
    """A set override beats the plan; zero means none allowed."""
    return F.coalesce(override, plan)


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return first_by(df, keys, [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key exists are dropped."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def first_claim(old: DataFrame, claims: DataFrame, key: str, col: str) -> DataFrame:
    """Set ``col`` where it is null; a claim never replaces another. ``claims`` has one row a key."""
    return old.join(claims.select(key, F.col(col).alias("_new")), key, "left").withColumn(col, F.coalesce(col, "_new")).drop("_new").select(*old.columns)


def seed_parents(rows: DataFrame, name: str = "name", parent: str = "parent_name") -> DataFrame:
    """The second seeding pass: each row's parent id, found by the parent's name."""
    ids = rows.select(F.col("id").alias("parent_id"), F.col(name).alias(parent))
    return rows.join(ids, parent, "left").select("id", name, "parent_id")


def registry_pick(df: DataFrame, keys: Sequence[str] = ("version", "module"), arrival: str = "arrival", long_format: str = "long_format") -> DataFrame:
    """Of modules with one name and version: the last with a long-format version, else the first that came."""
    order = [F.col(long_format).desc_nulls_last(), F.when(F.col(long_format), -F.col(arrival)).otherwise(F.col(arrival))]
    return first_by(df, list(keys), order)


def basename(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^.*/", "")


def manifest_version(version: Column, branch: Column) -> Column:
    """``N.0`` of a manifest's ``N.0.x.y``, else the branch's, else ``unknown``."""
    own = F.regexp_extract(version, r"^(\d+\.0)\.\d+\.\d+", 1)
    named = F.regexp_extract(branch, r"^(\d+\.\d+)", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(named, F.lit("")), F.lit("unknown"))


def search_audit(df: DataFrame, action: str | None, actor: str | None, offset: int, limit: int) -> DataFrame:
    """Audit rows by a part of the action and the actor's beginning, newest first."""
    from ..functions.scalars import escape_like, ilike_literal

    if action:
        df = df.filter(ilike_literal(F.col("action"), action))
    if actor:
        df = df.filter(F.col("actor").ilike(f"{escape_like(actor)}%"))
    return df.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)
