"""Whole answers about models, modules, profiles, styles, commands and tests, composed of the other operators.

Each works on all models, modules or queries of a table at once; a caller filters what is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MAGIC_FIELDS, ilike_literal, method_convention
from ..functions.text import literal_column, style_literal
from ..streaming.events import late_guard
from .graph import chain, closure, levels
from .joins import counted
from .lineage import cut, shuffled, sized
from .ranking import declaring_module, first_by, inherited_members, met_rows, tests_first

#: Tests and fields that a listing shows, modules of a profile's page.
TESTS_SHOWN, UNCOVERED_SHOWN, PROFILE_MODULES = 200, 200, 50


def model_summary(declared: DataFrame, members: DataFrame, views: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One row a model: its declaring module, how many modules extend it, and its fields, methods and views.

    ``declared`` has (model, module, is_definition, field_count, dependents, edition), ``members`` (model, kind, name), ``views`` (model).
    """
    keys = list(keys)
    main = declaring_module(declared, keys).select(*keys, F.col("module").alias("declared_in"))
    spread = declared.groupBy(*keys).agg(F.count_distinct("module").alias("modules"), F.count_if(~F.coalesce("is_definition", F.lit(False))).alias("extenders"))
    distinct = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("name")))
    counts = members.groupBy(*keys).agg(distinct("field").alias("fields"), distinct("method").alias("methods"))
    out = main.join(spread, keys).join(counts, keys, "left").join(views.groupBy(*keys).agg(F.count(F.lit(1)).alias("views")), keys, "left")
    return out.fillna(0, ["fields", "methods", "views"])


def fields_listing(tags: DataFrame, members: DataFrame, module: str | None = None, kind: str | None = None, part: str | None = None) -> DataFrame:
    """Fields of every start, own and inherited, with those that every model has before them (``builtin``).

    Built-in fields are left out where a module is asked for, and where any owner declares the name; they honour the kind and
    name filters. ``members`` has (model, name, module, edition, ttype).
    """
    tags = cut(tags)
    rows = inherited_members(tags, members, module).select("start", "name", "owner", "ttype", F.lit(False).alias("builtin"))
    if module is None:
        starts = tags.select("start").distinct()
        declared = cut(members.filter(F.col("name").isin(*(n for n, _, _ in MAGIC_FIELDS))).select("model", "name").distinct())
        n = met_rows(tags, declared)
        owned = tags.select("start", F.col("name").alias("owner")).join(shuffled(declared.withColumnRenamed("model", "owner")), "owner")
        owned = sized(owned.select("start", "name"), n, "start", "name").distinct()
        # six rows, one for each built-in field
        prelude = starts.select("start", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("ttype")) for n, t,
            _ in MAGIC_FIELDS])).alias("m")).select("start", "m.*")
        prelude = prelude.join(shuffled(owned), ["start", "name"], "left_anti").select("start", "name", F.col("start").alias("owner"), "ttype",
            F.lit(True).alias("builtin"))
        rows = rows.unionByName(prelude)
    if kind:
        rows = rows.filter(F.col("ttype") == kind)
    return rows.filter(ilike_literal(F.col("name"), part)) if part else rows


def view_type(col: Column, wanted: str) -> Column:
    """``tree`` and ``list`` name one view type."""
    return col.isin("tree", "list") if wanted in ("tree", "list") else col == wanted


def module_summary(modules: DataFrame, models: DataFrame, views: DataFrame, scripts: DataFrame, depends: DataFrame) -> DataFrame:
    """One row a module: models defined and extended, views, the commonest view type, scripts, direct dependencies and dependents.

    ``models`` has (module, name, is_definition), ``views`` (module, type), ``scripts`` (module), ``depends`` (src, dst).
    """
    own = models.groupBy("module").agg(F.count_distinct(F.when(F.col("is_definition"), F.col("name"))).alias("defined"),
        F.count_distinct(F.when(~F.col("is_definition"), F.col("name"))).alias("extended"))
    by_type = views.groupBy("module", "type").agg(F.count(F.lit(1)).alias("n"))
    top = by_type.groupBy("module").agg(F.sum("n").alias("views"), F.min(F.struct((-F.col("n")).alias("n"), "type"))["type"].alias("main_type"))
    d = depends.select("src", "dst").distinct()
    out = modules.join(own, "module", "left").join(top, "module", "left")
    for name, table in (("scripts", scripts), ("dependencies", d.withColumnRenamed("src", "module")), ("dependents", d.withColumnRenamed("dst", "module"))):
        out = counted(out, table, "module", name)
    return out.fillna(0, ["defined", "extended", "views"])


def load_order(roots: DataFrame, depends: DataFrame) -> DataFrame:
    """(root, name, depth, level): what each module pulls in, and in which wave it loads; loops have no level."""
    below = closure(roots, depends).unionByName(roots.select("root", F.col("root").alias("name"), F.lit(0).alias("depth")))
    names = depends.select(F.col("src").alias("name")).union(depends.select("dst")).union(roots.select("root")).distinct()
    return below.join(levels(depends, names), "name", "left").select("root", "name", "depth", "level")


def entity_lookup(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """``wanted`` (kind, name) with the module and id of the entity of that kind; an exact name beats one in other letter case.

    ``entities`` has (kind, name, module, id). Names that nothing has keep null columns.
    """
    e = entities.select(F.col("kind").alias("_k"), F.col("name").alias("found"), "module", "id", F.lower("name").alias("_low"))
    j = wanted.join(e, (F.col("kind") == F.col("_k")) & (F.lower("name") == F.col("_low")), "left")
    order = [(F.col("found") == F.col("name")).desc_nulls_last(), F.col("module").asc_nulls_last(), F.col("id").asc_nulls_last()]
    return first_by(j, ["kind", "name"], order).select("kind", "name", "found", "module", "id")


def profile_repos(profiles: DataFrame, repos: DataFrame) -> DataFrame:
    """(profile, repo, from_profile, depth): repositories of a profile and of all profiles above it; the nearest counts.

    ``profiles`` has (name, parent), ``repos`` (repo, profile).
    """
    up = chain(profiles.select(F.col("name").alias("start")), profiles).join(repos.select("repo", F.col("profile").alias("name")), "name")
    best = up.groupBy("start", "repo").agg(F.min(F.struct("depth", "name")).alias("b"))
    return best.select(F.col("start").alias("profile"), "repo", F.col("b.name").alias("from_profile"), F.col("b.depth").alias("depth"))


def profile_modules(profiles: DataFrame, repos: DataFrame, modules: DataFrame, page: int = 0, size: int = PROFILE_MODULES) -> DataFrame:
    """A page of each profile's modules by name, of at most ``PROFILE_MODULES``, with ``total``. ``modules`` has (name, repo)."""
    size = min(size, PROFILE_MODULES)
    # profiles with the same profiles of repositories above them have the same modules: one of them, the least, stands for all
    holders = repos.select(F.col("profile").alias("name")).distinct()
    up = chain(profiles.select(F.col("name").alias("start")), profiles).join(holders, "name")
    alike = cut(up.groupBy("start").agg(F.array_sort(F.collect_set("name")).alias("_above")))
    least = alike.groupBy("_above").agg(F.min("start").alias("_least"))
    least = cut(alike.join(least, "_above").select(F.col("start").alias("profile"), "_least"))
    here = alike.join(least.select(F.col("_least").alias("start")).distinct(), "start", "left_semi").select("start", F.explode("_above").alias("profile"))
    here = cut(here.join(repos.select("repo", "profile"), "profile").select("start", "repo").distinct())
    # a name of one repository alone is counted there once; names of several are counted for each profile
    held = cut(modules.select("repo", "name").distinct())
    spread = held.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("repo").alias("repo"))
    alone = spread.filter("_n = 1").groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
    several = held.join(spread.filter("_n > 1").select("name"), "name", "left_semi")
    counts = here.join(alone, "repo").groupBy("start").agg(F.sum("_n").alias("_n")).unionByName(
        here.join(several, "repo").select("start", "name").distinct().groupBy("start").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.groupBy("start").agg(F.sum("_n").alias("total"))
    # the first names of a profile are among the first of each of its repositories
    order = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("name"))
    first = held.withColumn("place", order("repo")).filter(F.col("place") <= (page + 1) * size).select("repo", "name")
    own = here.join(first, "repo").select("start", "name").distinct().withColumn("place", order("start"))
    shown = own.filter((F.col("place") > page * size) & (F.col("place") <= (page + 1) * size)).join(total, "start")
    return least.join(shown.withColumnRenamed("start", "_least"), "_least").select("profile", "name", "place", "total")


def children(profiles: DataFrame) -> DataFrame:
    """(name, child): one level down, null for profiles without children."""
    kids = profiles.filter("parent is not null").select(F.col("parent").alias("name"), F.col("name").alias("child"))
    return profiles.select("name").join(kids, "name", "left")


def repos_in_state(repos: DataFrame, profiles: DataFrame, status: str) -> DataFrame:
    """Repositories of a status with their profile's version; those without a profile are left out."""
    return repos.filter(F.col("status") == status).join(profiles.select(F.col("name").alias("profile"), "version"), "profile").select("repo",
        "profile", "version")


def unclaimed(rows: DataFrame, email: str) -> DataFrame:
    """Active subscriptions under an e-mail address, in any letter case, that nobody has claimed."""
    return rows.filter((F.lower("email") == email.lower()) & (F.col("status") == "active") & F.col("claimed_by").isNull())


def newest(rows: DataFrame, keys: Sequence[str], time: str, tie: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows of each key, newest first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and their entities by module and kind."""
    return chunks.groupBy("module", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("entity").alias("entities"))


def override_points(methods: DataFrame) -> DataFrame:
    """Each method with its convention and the chain of modules that define it, by module: (model, name, version, kind, super_safety,
    return_required, with_super, chain).

    ``methods`` has (model, name, version, module, edition, has_super). A method of one module is a chain of one.
    """
    link = F.struct("module", "edition", F.coalesce("has_super", F.lit(False)).alias("has_super"))
    grouped = methods.groupBy("model", "name", "version").agg(F.count_if(F.coalesce("has_super", F.lit(False))).alias("with_super"), F.array_sort(F.collect_list(link)).alias("chain"))
    return grouped.withColumn("_c", method_convention(F.col("name"))).select("model", "name", "version", "_c.kind", "_c.super_safety", "_c.return_required", "with_super", "chain")


def override_diff(points: DataFrame, old: str, new: str) -> DataFrame:
    """How each method's chain differs between two versions of ``override_points``: (model, name, change, added, removed, kind, super_safety).

    ``change`` is added, removed, changed or same; ``added`` and ``removed`` are modules in order. ``kind`` and ``super_safety`` say "old -> new"
    where they differ.
    """
    side = lambda v, p: points.filter(F.col("version") == v).select("model", "name", *[F.col(c).alias(p + c) for c in ("kind", "super_safety")],
        F.transform("chain", lambda x: x["module"]).alias(p + "modules"))
    both = side(old, "_old_").join(side(new, "_new_"), ["model", "name"], "full")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("_old_modules", none), F.coalesce("_new_modules", none)
    moved = lambda c: F.when(F.col(f"_old_{c}").isNotNull() & F.col(f"_new_{c}").isNotNull() & (F.col(f"_old_{c}") != F.col(f"_new_{c}")),
        F.concat_ws(" -> ", f"_old_{c}", f"_new_{c}")).otherwise(F.coalesce(f"_new_{c}", f"_old_{c}"))
    gone, fresh = F.array_except(a, b), F.array_except(b, a)
    change = F.when(F.col("_old_modules").isNull(), "added").when(F.col("_new_modules").isNull(), "removed").when((F.size(gone) > 0) | (F.size(fresh) > 0), "changed").otherwise("same")
    return both.select("model", "name", change.alias("change"), fresh.alias("added"), gone.alias("removed"), moved("kind").alias("kind"), moved("super_safety").alias("super_safety"))


def style_overrides(chunks: DataFrame, imports: DataFrame, queries: Sequence[str], limit: int = 5) -> DataFrame:
    """(query, place, path, entity_name, importers): where a literal style name stands, best first, and how many sheets import those.

    ``chunks`` has (path, module, entity_name, content, chunk_idx), ``imports`` (src, dst). The queries are a caller's few texts; each task looks for
    all of them in its rows. Variables are looked for in the content, all else in the entity's name; shorter ones come first.
    Queries that name nothing literally give no rows.
    """
    wanted = F.array(*[F.struct(F.lit(q).alias("query"), F.lower(F.trim(F.lit(q))).alias("part"), literal_column(F.lit(q)).alias("column"),
        style_literal(F.lit(q)).alias("literal")) for q in queries])
    text = lambda w: F.when(w["column"] == "content", F.col("content")).otherwise(F.col("entity_name"))
    hits = chunks.select("path", "module", "entity_name", "chunk_idx", F.explode(F.transform(
        F.filter(wanted, lambda w: w["literal"] & F.contains(F.lower(text(w)), w["part"])),
            lambda w: F.struct(w["query"].alias("query"), F.length(text(w)).alias("size")))).alias("w"))
    hits = hits.select("path", "module", "entity_name", "chunk_idx", "w.*")
    order = Window.partitionBy("query").orderBy("size", "module", "path", "chunk_idx")
    best = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return counted(best.select("query", "place", "path", "entity_name"), imports.select(F.col("dst").alias("path"), "src").distinct(), "path", "importers")


def stylesheets(counts: DataFrame, imports: DataFrame) -> DataFrame:
    """One row a sheet: its counters (``counts``) and the sheets it imports, in path order."""
    targets = imports.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("targets"))
    return counts.join(targets, "path", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def flag_help(wanted: DataFrame, flags: DataFrame, replaced: DataFrame) -> DataFrame:
    """``wanted`` (command, flag) with status, type, default and what replaces the flag: by an edge, else by the flag's own note.

    ``flags`` has (command, flag, status, type, default, replacement), ``replaced`` (command, flag, successor).
    """
    edge = replaced.groupBy("command", "flag").agg(F.min("successor").alias("_successor"))
    j = wanted.join(flags, ["command", "flag"], "left").join(edge, ["command", "flag"], "left")
    return j.select("command", "flag", F.col("status").isNotNull().alias("known"), "status", "type", "default",
        F.coalesce("_successor", "replacement").alias("replacement"))


def command_help(commands: DataFrame, flags: DataFrame) -> DataFrame:
    """One row a command: its flags in order and its sub-commands, whose names begin with it and a space; ``top`` where it is no sub-command."""
    own = flags.groupBy(F.col("command").alias("name")).agg(F.sort_array(F.collect_set("flag")).alias("flags"))
    # a sub-command's name is cut at its spaces, so it meets its parents by equality
    words = F.split("name", " ")
    above = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, 1, k), " "))
    subs = commands.filter(F.col("name").contains(" ")).select(F.explode(above).alias("_parent"), "name").groupBy(
        F.col("_parent").alias("_name")).agg(F.sort_array(F.collect_set("name")).alias("subcommands"))
    empty = F.array().cast("array<string>")
    out = commands.join(own, "name", "left").join(subs, F.col("name") == F.col("_name"), "left")
    return out.select("name", F.coalesce("flags", empty).alias("flags"), F.coalesce("subcommands", empty).alias("subcommands"),
        (~F.col("name").contains(" ")).alias("top"))


def tests_covering(edges: DataFrame, tests: DataFrame, classes: DataFrame, target: Sequence[str]) -> DataFrame:
    """Tests that refer to each target (the columns ``target`` of ``edges``), with their class's type, at most ``TESTS_SHOWN`` a target.

    ``edges`` has the target and ``test``; ``tests`` (test, test_class, module, name, via, asserts); ``classes`` (test_class, module, test_type).
    """
    rows = edges.select(*target, "test").distinct().join(tests, "test").join(classes, ["test_class", "module"], "left")
    via = F.when(F.col("via") == "assert", 0).when(F.col("via") == "body", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*target).orderBy(via, F.desc("asserts"), "module", "name", "test"))
    return rows.withColumn("place", place).filter(F.col("place") <= TESTS_SHOWN)


def test_class_inspect(classes: DataFrame, methods: DataFrame, inherits: DataFrame) -> DataFrame:
    """One row a test class: its bases, how many methods stand under its name and module, how many classes derive from it.

    Methods are found by class and module name, so same-named classes of one module are one. ``inherits`` has (name, base).
    """
    m = methods.groupBy(F.col("test_class").alias("name"), "module").agg(F.count_distinct("method").alias("methods"), F.sum("asserts").alias("asserts"))
    bases = inherits.groupBy("name").agg(F.sort_array(F.collect_set("base")).alias("bases"))
    kids = inherits.select(F.col("base").alias("name"), F.col("name").alias("_kid")).distinct().groupBy("name").agg(F.count("_kid").alias("subclasses"))
    out = classes.select("name", "module").distinct().join(m, ["name", "module"], "left").join(bases, "name", "left").join(kids, "name", "left")
    return out.withColumn("bases", F.coalesce("bases", F.array().cast("array<string>"))).fillna(0, ["methods", "asserts", "subclasses"])


def test_bases(helpers: DataFrame, inherits: DataFrame, origin: str = "framework") -> DataFrame:
    """The framework's helper classes with the helpers that each derives from."""
    own = helpers.filter(F.col("origin") == origin).select("name", "test_type")
    up = inherits.join(helpers.select(F.col("name").alias("base")).distinct(), "base", "left_semi").groupBy("name").agg(
        F.sort_array(F.collect_set("base")).alias("parents"))
    return own.join(up, "name", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def coverage_audit(fields: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a module: its fields, those that no test refers to, their share in percent, and the first ``UNCOVERED_SHOWN`` of them by model and name.

    ``fields`` has (module, model, name), ``edges`` (model, name, module) of covered fields. Fields alone are audited, as in the reference.
    """
    covered = edges.select("module", "model", "name").distinct().withColumn("_c", F.lit(True))
    rows = fields.select("module", "model", "name").distinct().join(covered, ["module", "model", "name"], "left")
    missing = rows.filter("_c is null")
    place = F.row_number().over(Window.partitionBy("module").orderBy("model", "name"))
    shown = missing.withColumn("_p", place).filter(F.col("_p") <= UNCOVERED_SHOWN).groupBy("module").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "model", "name"))), lambda x: F.concat_ws(".", x["model"].cast("string"),
            x["name"])).alias("shown"))
    totals = rows.groupBy("module").agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("_c").isNull()).alias("uncovered"))
    out = totals.join(shown, "module", "left").withColumn("shown", F.coalesce("shown", F.array().cast("array<string>")))
    return out.withColumn("percent", F.bround(100.0 * (F.col("fields") - F.col("uncovered")) / F.col("fields"), 1))


def script_suites(suites: DataFrame, framework: str | None = None) -> DataFrame:
    """Script test suites with a path, of one framework or all, in listing order."""
    rows = suites.filter(F.col("path").isNotNull())
    rows = rows.filter(F.col("framework") == framework) if framework else rows
    return rows.orderBy("framework", "path")


def webhook_batch(events: DataFrame, known: DataFrame, state: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """One batch of a vendor's webhooks: verify, record, apply, mark. Returns the event log and the subscriptions after it.

    ``events`` has (vendor, event_id, received, valid, subscription, event_at, status); ``known`` the log (vendor, event_id, processed_at);
    ``state`` (subscription, status, event_at). Events that aren't valid are not recorded. A replay of a finished event changes nothing; one that was recorded
    but never finished is applied again. Of a subscription's events, one older than what is stored changes nothing.
    """
    fresh = events.filter("valid").groupBy("vendor", "event_id").agg(F.min_by(F.struct("subscription", "event_at", "status", "received"),
        "received").alias("e")).select("vendor", "event_id", "e.*")
    open_ = fresh.join(known.filter("processed_at is not null").select("vendor", "event_id"), ["vendor", "event_id"], "left_anti")
    log = known.join(open_.select("vendor", "event_id"), ["vendor", "event_id"], "left_anti").unionByName(
        open_.select("vendor", "event_id", F.lit(now).alias("processed_at")))
    # stored rows are the first arrivals of their subscriptions
    stored = state.select("subscription", "status", "event_at", F.lit(None).cast("timestamp").alias("received"))
    rows = stored.unionByName(open_.select("subscription", "status", "event_at", "received"))
    arrival = F.struct(F.col("received").isNotNull().alias("new"), "received", "event_at", "status")
    after = late_guard(rows.withColumn("_arrival", arrival), "subscription", "event_at", "_arrival", ["status"])
    return log, after


__all__ = [
    "chunk_counts", "children", "command_help", "coverage_audit", "entity_lookup", "fields_listing", "flag_help", "load_order", "model_summary",
        "module_summary", "newest", "override_diff", "override_points", "profile_modules",
    "profile_repos", "repos_in_state", "script_suites", "style_overrides", "stylesheets", "test_bases", "test_class_inspect", "tests_covering",
        "tests_first", "unclaimed", "view_type", "webhook_batch",
]
