"""Pages of what belongs to a model or a module: methods, extenders, views, components, templates, patches and tests.

Each listing works on all models or modules at once and gives a page of each, with its place and the number of all its rows. Only rows up to the page's end
leave the first sort; totals are counted by their own aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edition_rank, ilike_literal
from .ranking import inherited_members
from .tools import view_type as view_type_is

#: Fixed value: rows of a page where the caller names no other number.
PAGE = 200


def page_of(df: DataFrame, group: Sequence[str], order: Sequence[Column], start: int = 0, limit: int = PAGE) -> DataFrame:
    """``df`` with ``place`` (from 0, by ``order`` within the group) and ``total``, cut to one page of each group. The order must end in a key."""
    group = list(group)
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    page = placed.filter(F.col("place") < start + limit).filter(F.col("place") >= start)
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total")).withColumnsRenamed({g: f"_{g}" for g in group})
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return page.join(totals, on).drop(*[f"_{g}" for g in group])


def methods_listing(tags: DataFrame, methods: DataFrame, part: str | None = None, start: int = 0, limit: int = PAGE) -> DataFrame:
    """Methods of every start, own and inherited, from the nearest owner: start, name, owner, module, overridden, place, total.

    ``tags`` are ancestors by INHERITS alone, since delegation passes no methods on; ``methods`` has (model, name, module, edition). A method is overridden
    where two modules or more define it on its owner.
    """
    rows = methods.withColumn("ttype", F.lit(None).cast("string"))
    rows = rows.filter(ilike_literal(F.col("name"), part)) if part else rows
    nearest = inherited_members(tags, rows).select("start", "name", "owner", "module")
    spread = methods.groupBy(F.col("model").alias("owner"), "name").agg((F.count_distinct("module") >= 2).alias("overridden"))
    return page_of(nearest.join(spread, ["owner", "name"]), ["start"], [F.col("name")], start, limit)


def extenders(models: DataFrame, start: int = 0, limit: int = PAGE) -> DataFrame:
    """Modules that extend each model: those with more fields first, then with more dependents, then by edition and name.

    ``models``: model, version, module, is_definition, field_count, dependents, edition.
    """
    order = [F.col("field_count").desc_nulls_last(), F.col("dependents").desc_nulls_last(), edition_rank(F.col("edition")), F.col("module").asc_nulls_last()]
    return page_of(models.filter(~F.coalesce("is_definition", F.lit(False))), ["model", "version"], order, start, limit)


def views_listing(views: DataFrame, by: str = "model", wanted: str | None = None, start: int = 0, limit: int = PAGE) -> DataFrame:
    """Views of each model (or module): by edition of the module, its name, then xmlid. ``views``: xmlid, type, model, module, version, edition; ``wanted`` is a view type."""
    rows = views if wanted is None else views.filter(view_type_is(F.col("type"), wanted))
    return page_of(rows, [by, "version"], [edition_rank(F.col("edition")), F.col("module").asc_nulls_last(), F.col("xmlid")], start, limit)


def components_listing(components: DataFrame, bound_model: str | None = None, start: int = 0, limit: int = PAGE) -> DataFrame:
    """Components of each module by name. ``components``: module, version, name, bound_model, template."""
    rows = components if bound_model is None else components.filter(F.col("bound_model") == bound_model)
    return page_of(rows, ["module", "version"], [F.col("name"), F.col("template").asc_nulls_last()], start, limit)


def templates_listing(templates: DataFrame, extends: DataFrame, start: int = 0, limit: int = PAGE) -> DataFrame:
    """Templates of each module by xmlid, with the template that each extends where that one is known.

    ``templates``: xmlid, module, version, unresolved; ``extends``: src, dst, version.
    """
    known = templates.filter(~F.coalesce("unresolved", F.lit(False))).select(F.col("xmlid").alias("dst"), "version").distinct()
    parent = extends.join(known, ["dst", "version"], "left_semi").select(F.col("src").alias("xmlid"), "version", F.col("dst").alias("parent_xmlid")).distinct()
    rows = templates.filter(~F.coalesce("unresolved", F.lit(False))).join(parent, ["xmlid", "version"], "left")
    return page_of(rows.select("xmlid", "module", "version", "parent_xmlid"), ["module", "version"], [F.col("xmlid"), F.col("parent_xmlid").asc_nulls_last()], start, limit)


def patches_listing(patches: DataFrame, era: str | None = None, target: str | None = None, start: int = 0, limit: int = PAGE) -> DataFrame:
    """Script patches of each version: by edition and name of the module, then target and name. ``patches``: version, module, edition, era, target, patch_name."""
    for c, v in (("era", era), ("target", target)):
        patches = patches if v is None else patches.filter(F.col(c) == v)
    order = [edition_rank(F.col("edition")), F.col("module").asc_nulls_last(), F.col("target").asc_nulls_last(), F.col("patch_name").asc_nulls_last()]
    return page_of(patches, ["version"], order, start, limit)


def module_tests(classes: DataFrame, methods: DataFrame, inherits: DataFrame, start: int = 0, limit: int = PAGE) -> DataFrame:
    """Test classes of each module by name: test methods, assertions, and whether other modules' tests build on the class.

    ``classes``: id, name, module, version; ``methods``: class_id, name, asserts; ``inherits``: src, dst (class ids).
    """
    counted = methods.filter(F.col("name").startswith("test")).groupBy(F.col("class_id").alias("id")).agg(F.count(F.lit(1)).alias("tests"), F.sum("asserts").alias("asserts"))
    a, b = classes.select(F.col("id").alias("src"), F.col("module").alias("_m")), classes.select(F.col("id").alias("dst"), "module")
    shared = inherits.join(a, "src").join(b, "dst").filter(F.col("_m") != F.col("module")).select(F.col("dst").alias("id"), F.lit(True).alias("shared")).distinct()
    rows = classes.join(counted, "id", "left").join(shared, "id", "left").fillna(0, ["tests", "asserts"]).fillna(False, ["shared"])
    return page_of(rows, ["module", "version"], [F.col("name"), F.col("id")], start, limit)
