"""Sinks and post-pass jobs over node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .lineage import shuffled, sized
from .ranking import first_by


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], union_cols: Sequence[str] = (), or_cols: Sequence[str] = ()) -> DataFrame:
    """Key-matched upsert of one row a key: new values where set, else old ones.

    ``union_cols`` only grow (old names first), ``or_cols`` stay true once true.
    """
    keys = list(keys)
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values])
    b = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])

    def merged(c: str) -> Column:
        o, n = F.col(f"_old_{c}"), F.col(f"_new_{c}")
        if c in union_cols:
            empty = F.array().cast(old.schema[c].dataType)
            return F.array_union(F.coalesce(o, empty), F.coalesce(n, empty))
        if c in or_cols:
            return F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False))
        return F.coalesce(n, o)

    return a.join(b, keys, "full").select(*keys, *[merged(c).alias(c) for c in values]).select(*old.columns)


def replace_partition(old: DataFrame, new: DataFrame, scope: Sequence[str], dedup: Sequence[str], order: str) -> DataFrame:
    """Vector sink: drop what the new rows' scopes hold, insert the new rows, the last of each ``dedup`` key wins."""
    keep = old.join(new.select(*scope).distinct(), list(scope), "left_anti")
    return keep.unionByName(first_by(new, list(dedup), [F.col(order).desc_nulls_last()]).select(*old.columns))


def keep_old_vectors(old: DataFrame, new: DataFrame, scope: Sequence[str], vec: str) -> DataFrame:
    """Scopes whose embedding failed altogether keep their old rows; chunks without a vector are left out."""
    good = new.filter(F.col(vec).isNotNull())
    return old.join(good.select(*scope).distinct(), list(scope), "left_anti").unionByName(good.select(*old.columns))


def same_name_inherits(models: DataFrame) -> DataFrame:
    """Edges extender -> definition of one model name in other modules. ``models``: name, module, version, is_definition.

    Extenders point at definitions alone (K x D edges), not at each other. Repeats go before the join, so that no edge is hashed or sorted.
    """
    n = models.count()
    side = lambda which, module: sized(models.filter(which).select("name", "version", F.col("module").alias(module)), n, "name", "version").distinct()
    met = side("not is_definition", "src_module").join(shuffled(side("is_definition", "dst_module")), ["name", "version"])
    return met.filter(F.col("src_module") != F.col("dst_module")).select("name", "version", "src_module", "dst_module")


def is_definition(name: Column, own_name_set: Column, inherit: Column) -> Column:
    """A model is defined where its name is given and isn't among what it inherits."""
    return own_name_set & ~F.coalesce(F.array_contains(inherit, name), F.lit(False))


#: The module of placeholders; kinds that have placeholders; kinds whose key has no module, so that a real row can take a placeholder's place.
UNRESOLVED = "__unresolved__"
PLACEHOLDER_KINDS = ("Model", "View", "QWebTmpl", "OWLComp")
HEALED_KINDS = ("View", "QWebTmpl")
#: Kinds that go with their module.
CHILD_KINDS = ("Model", "Field", "Method", "View", "QWebTmpl", "Report", "JSPatch", "OWLComp")


def _of(version: str | None) -> Column:
    return F.lit(True) if version is None else F.coalesce(F.col("version") == version, F.lit(False))


def _flag(c: str = "unresolved") -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges none of whose ends is a node of ``gone`` (id)."""
    ids = gone.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def gc_placeholders(nodes: DataFrame, edges: DataFrame, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without placeholders, then healed.

    ``nodes``: id, kind, module, version, unresolved; ``edges``: src, dst, unresolved (both may have more columns). A placeholder carries the flag *and* the
    module of placeholders; edges reaching it don't keep it, they go with it. A real row that still carries the flag stays.
    """
    hit = F.col("kind").isin(*PLACEHOLDER_KINDS) & _of(version) & _flag() & F.coalesce(F.col("module") == UNRESOLVED, F.lit(False))
    left = nodes.filter(~F.coalesce(hit, F.lit(False)))
    return heal_flags(left, _without(edges, nodes.filter(hit)), version)


def heal_flags(nodes: DataFrame, edges: DataFrame, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Clear the flag of rows that are resolved by now: views and templates of a real module, and edges to any node of a real module.

    A null module is no placeholder's. Edges to a node that isn't there keep their flag.
    """
    real = F.coalesce(F.col("module"), F.lit("")) != UNRESOLVED
    stale = F.coalesce(F.col("kind").isin(*HEALED_KINDS), F.lit(False)) & _of(version) & real
    healed = nodes.withColumn("unresolved", F.when(stale & _flag(), False).otherwise(F.col("unresolved"))).select(*nodes.columns)
    ends = nodes.filter(_of(version) & real).select(F.col("id").alias("dst"), F.lit(True).alias("_real")).distinct()
    clear = edges.join(ends, "dst", "left").withColumn("unresolved", F.when(F.col("_real") & _flag(), False).otherwise(F.col("unresolved")))
    return healed, clear.select(*edges.columns)


def gc_bundles(bundles: DataFrame, contributes: DataFrame, includes: DataFrame, extends: DataFrame, version: str | None = None) -> DataFrame:
    """Asset bundles (id, version) that a module contributes to, that take part in an include, or that another extends; the rest goes.

    ``contributes`` (module, bundle), ``includes`` (src, dst) in either direction, ``extends`` (src, dst) inbound alone.
    """
    used = contributes.select(F.col("bundle").alias("id")).union(includes.select("src")).union(includes.select("dst")).union(extends.select("dst")).distinct()
    return bundles.filter(~_of(version)).unionByName(bundles.filter(_of(version)).join(used, "id", "left_semi").select(*bundles.columns))


def gc_dep_stubs(modules: DataFrame, children: DataFrame, edges: DataFrame, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Modules and edges without stubs: modules of no repository that nothing is defined in. Their edges go with them.

    ``modules``: id, version, repo_id; ``children``: module (an id); ``edges``: src, dst. A stub that is still depended on comes back with the next scan.
    """
    stubs = modules.filter(_of(version) & F.col("repo_id").isNull()).join(children.select(F.col("module").alias("id")).distinct(), "id", "left_anti")
    gone = stubs.select("id")
    return modules.join(gone, "id", "left_anti").select(*modules.columns), _without(edges, gone)


def delete_repo(modules: DataFrame, nodes: DataFrame, edges: DataFrame, repo: str, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modules, nodes and edges without a repository's modules of one version and what is defined in them.

    ``modules``: id, name, repo, version; ``nodes``: id, kind, module, version; ``edges``: src, dst over both. Children go by module
    name and version. Bundles and style sheets are shared by modules of a version, so they stay.
    """
    hit = F.coalesce((F.col("repo") == repo) & (F.col("version") == version), F.lit(False))
    gone = modules.filter(hit)
    names = gone.select(F.col("name").alias("module"), "version").distinct()
    children = nodes.filter(F.col("kind").isin(*CHILD_KINDS)).join(names, ["module", "version"], "left_semi")
    left = nodes.join(children.select("id"), "id", "left_anti").select(*nodes.columns)
    return modules.filter(~hit), left, _without(edges, gone.select("id").union(children.select("id")))


def gc_stale(nodes: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes of modules that the last scan didn't see go."""
    return nodes.join(seen.select(*keys).distinct(), list(keys), "left_semi")


def inherits_test(classes: DataFrame, helpers: DataFrame) -> DataFrame:
    """(name, base, target, kind): each base found among helpers of the version, else among test classes.

    ``classes``: name, version, bases; ``helpers``: name, version.
    """
    b = classes.select("name", "version", F.explode("bases").alias("base")).distinct()
    h = helpers.select(F.col("name").alias("base"), "version", F.lit("helper").alias("_h")).distinct()
    c = classes.select(F.col("name").alias("base"), "version", F.lit("class").alias("_c")).distinct()
    return b.join(h, ["base", "version"], "left").join(c, ["base", "version"], "left").withColumn("kind", F.coalesce("_h", "_c")).filter(
        "kind is not null").select("name", "version", "base", "kind")


def promote_helpers(classes: DataFrame, edges: DataFrame, helpers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test classes with ``is_helper``, and the helpers with one row for each promoted class.

    ``classes``: id, name, module, version, defines_no_test_methods, is_helper, profile; ``edges``: src, dst (ids); ``helpers``: name, module, version, origin,
    profile. A class is promoted where another class derives from it and it has no test methods of its own; a class with tests never is. Once
    promoted it stays so. A helper that is there takes the origin and joins the profiles.
    """
    used = edges.select(F.col("dst").alias("id")).distinct().withColumn("_used", F.lit(True))
    fits = F.col("_used") & F.coalesce("defines_no_test_methods", F.lit(False))
    out = classes.join(used, "id", "left").withColumn("is_helper", F.coalesce(fits, F.lit(False)) | F.coalesce("is_helper", F.lit(False))).select(*classes.columns)
    keys = ["name", "module", "version"]
    rows = out.filter("is_helper").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("profile", F.array().cast("array<string>")))))).alias("profile"))
    return out, upsert(helpers, rows.select(*keys, F.lit("addon").alias("origin"), "profile"), keys, ["profile"])


def coverage_edges(refs: DataFrame, members: DataFrame) -> DataFrame:
    """Test -> member edges of definition models; a field is covered in every module that declares it.

    ``refs``: test, model, name, via; ``members``: model, name, module, is_definition.
    """
    return refs.join(members.filter("is_definition").select("model", "name", "module"), ["model", "name"]).select("test", "model", "name", "module",
        "via").distinct()


def reachable_within(roots: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """What the roots depend on at any depth, restricted to a list of names afterwards."""
    return closure(roots, edges, None).join(names.select("name"), "name", "left_semi")


def gc_unseen(nodes: DataFrame, seen: DataFrame, scanned: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Rows of scanned scopes that the scan didn't see go (tests, test classes); rows of other scopes stay."""
    stale = nodes.join(scanned.select(*scope).distinct(), list(scope), "left_semi").join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return nodes.join(stale.select(*keys).distinct(), list(keys), "left_anti")
