"""Traversals over edge tables. Each hop is a join followed by an aggregate by name, never a path.

Walks without a stated bound go on until a hop finds nothing new, however deep the graph is.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .lineage import Growing, cut, shuffled
from .ordering import reach

INHERITS, DELEGATES = "INHERITS", "DELEGATES_TO"
#: Order of edge kinds at one depth.
KIND_RANK = {INHERITS: 0, DELEGATES: 1}

#: Hops of a walk that share one plan; after them, what is under way is written.
WALK_HOPS = 6


def _kind_rank(kind: Column) -> Column:
    return F.when(kind == INHERITS, 0).otherwise(1)


def ancestors(starts: DataFrame, edges: DataFrame, hops: int = 3, kinds: Sequence[str] = (INHERITS, DELEGATES)) -> DataFrame:
    """(start, name, depth, kind, via_field): the nearest way from each start to each ancestor's name.

    ``starts`` has ``start``; ``edges`` has ``src``, ``dst``, ``kind``, ``via_field``. A hop never re-enters the name it
    leaves. At one depth INHERITS comes before DELEGATES_TO, then the least via_field. The start has depth 0. A hop
    joins the names of the last depth with the edges and keeps the nearest way to each name, so many paths to one name
    cost one row and no hop is computed twice.
    """
    step = edges.filter(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst"))).select("src", "dst",
        F.struct(_kind_rank(F.col("kind")).alias("r"), F.coalesce("via_field", F.lit("")).alias("v"), "kind", "via_field").alias("edge")).distinct()
    none = F.lit(None).cast(step.schema["edge"].dataType)
    found = starts.select("start", F.col("start").alias("name"), F.lit(0).alias("depth"), none.alias("edge")).distinct()
    for depth in range(1, hops + 1):
        met = found.join(shuffled(step.withColumnRenamed("edge", "_edge")), (F.col("name") == F.col("src")) & (F.col("depth") == depth - 1), "left")
        own = F.struct("name", F.col("depth"), F.col("edge"))
        beyond = F.struct(F.col("dst").alias("name"), F.lit(depth).alias("depth"), F.col("_edge").alias("edge"))
        both = met.select("start", F.inline(F.when(F.col("dst").isNull(), F.array(own)).otherwise(F.array(own, beyond))))
        found = both.groupBy("start", "name").agg(F.min(F.struct("depth", "edge")).alias("b")).select("start", "name", "b.depth", "b.edge")
    return found.select("start", "name", "depth", F.col("edge.kind").alias("kind"), F.col("edge.via_field").alias("via_field"))


#: Edges that a single request's hop may bring to the driver; a request that meets more is walked by joins.
FEW_EDGES = 5_000


def ancestors_of(names: Sequence, edges: DataFrame, hops: int = 3, kinds: Sequence[str] = (INHERITS, DELEGATES), most: int = FEW_EDGES) -> tuple[DataFrame, list | None]:
    """``ancestors`` of a few starts, and all names found (None where there were too many edges for the driver).

    Each hop reads the edges of the names of the last depth alone: a filter that reaches the scan, no join and no shuffle of the graph.
    A hop with more than ``most`` edges hands the request to ``ancestors``, with the same rows.
    """
    spark, names = edges.sparkSession, list(dict.fromkeys(names))
    name_type = to_arrow_type(edges.schema["src"].dataType)
    schema = pa.schema([("start", name_type), ("name", name_type), ("depth", pa.int32()), ("kind", pa.string()), ("via_field", pa.string())])
    found = {(n, n): (0, None, None) for n in names}
    front = {(n, n) for n in names}
    for depth in range(1, hops + 1):
        here = sorted({name for _, name in front})
        step = edges.filter(F.col("src").isin(here) & F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst"))).select("src", "dst", "kind", "via_field").distinct()
        rows = step.limit(most + 1).collect() if here else []
        if len(rows) > most:
            return ancestors(spark.createDataFrame(pa.table([pa.array(names, name_type)], ["start"])), edges, hops, kinds), None
        best: dict = {}
        for r in rows:
            for start in (s for s, name in front if name == r.src):
                order = (KIND_RANK.get(r.kind, 1), r.via_field or "", r.kind, r.via_field)
                if (start, r.dst) not in found and (best.get((start, r.dst)) is None or order[:2] < best[start, r.dst][:2]):
                    best[start, r.dst] = order
        found |= {k: (depth, o[2], o[3]) for k, o in best.items()}
        front = set(best)
    columns = zip(*((s, n, *v) for (s, n), v in found.items())) if found else [[]] * 5
    tags = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema)], schema=schema))  # a local relation: no task, no shuffle
    return tags, sorted({n for _, n in found})


def is_subtype(pairs: DataFrame, edges: DataFrame, hops: int = 5, tags: DataFrame | None = None) -> DataFrame:
    """``pairs`` (comodel, target) with ``ok``: equal, or the target is an ancestor by INHERITS. ``tags`` are the comodels' ancestors where they are known."""
    own = pairs.select(F.col("comodel").alias("start"))
    reach = (ancestors(own, edges, hops, (INHERITS,)) if tags is None else tags).select(F.col("start").alias("comodel"), F.col("name").alias("target"), F.lit(True).alias("_hit"))
    return pairs.join(reach, ["comodel", "target"], "left").select(*pairs.columns, F.coalesce("_hit", F.lit(False)).alias("ok"))


def closure(roots: DataFrame, edges: DataFrame, hops: int | None = 20) -> DataFrame:
    """(root, name, depth): everything that a root depends on, at its shortest depth; the root itself is left out.

    Joins by hop from the names that the last hop met. Each hop is written. Once the hops since the last comparison have met as many rows as were found before, they
    are compared with these, so cycles end, and what was found is shuffled no oftener than its growth pays for. Between two comparisons a name may be met again.
    The loop ends when nothing new is met, or after ``hops`` (20 is the dependency listing's own bound; None has no bound).
    """
    step = cut(edges.select("src", "dst").filter("dst is not null").distinct())
    found, depth = Growing(roots.select("root", F.col("root").alias("name"), F.lit(0).alias("depth")).distinct()), 0
    while hops is None or depth < hops:
        front, size, walk, walked = found.last().filter(F.col("depth") == depth), found.all().count(), None, 0
        while walked < size and (hops is None or depth < hops):
            depth += 1
            near = front.select("root", "name").join(step, F.col("name") == F.col("src")).select("root", F.col("dst").alias("name")).distinct().withColumn("depth", F.lit(depth))
            if walk is None:
                walk = Growing(near)
            else:
                walk.add(near)
            front = walk.last()
            met = front.count()
            walked += met
            if not met:
                break
        if walk is None:
            break
        fresh = walk.all().groupBy("root", "name").agg(F.min("depth").alias("depth"))
        if not found.add(fresh.join(shuffled(found.all().select("root", "name")), ["root", "name"], "left_anti")):
            break
    return found.all().filter("depth > 0")


def walk_paths(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Resolve dotted paths: (model, path) to the stop (``status``, ``at``), final ``ttype`` and ``comodel``.

    ``members`` has (model, name, ttype, comodel), one row for each model and name. Hops before the last must be relational.
    Status: ok, missing, not_relational, dangling_comodel. A path of dots alone is missing at 0. Each hop is one
    join for all paths that are still under way, and every part is walked however long the path is.
    """
    parts = F.filter(F.split("path", r"\."), lambda p: p != "")
    null = F.lit(None).cast("string")
    now = paths.select("model", "path", parts.alias("parts"))
    now = now.select("model", "path", "parts", F.col("model").alias("here"), F.when(F.size("parts") == 0, "missing").alias("status"), F.lit(0).alias("at"),
        null.alias("ttype"), null.alias("comodel"))
    longest = now.agg(F.max(F.size("parts"))).first()[0] or 0
    have = members.select(F.col("model").alias("_m"), F.col("name").alias("_n"), F.col("ttype").alias("_t"), F.col("comodel").alias("_c"))
    if longest > WALK_HOPS:
        have = cut(have)
    stopped = None
    for k in range(longest):
        if k and k % WALK_HOPS == 0:  # stopped paths are set aside, so a few long ones don't drag all along
            now = cut(now)
            ended = now.filter("status is not null")
            stopped = ended if stopped is None else stopped.unionByName(ended)
            now = now.filter("status is null")
        live = F.col("status").isNull()
        hop = F.when(live, F.get("parts", F.lit(k)))
        joined = now.withColumn("_hop", hop).join(have, (F.col("here") == F.col("_m")) & (F.col("_hop") == F.col("_n")), "left")
        last = F.size("parts") == k + 1
        state = (
            F.when(~live, F.col("status")).when(F.col("_n").isNull(), "missing").when(last, "ok")
            .when(~F.col("_t").isin("many2one", "one2many", "many2many"), "not_relational").when(F.col("_c").isNull(), "dangling_comodel")
        )
        now = joined.select(
            "model", "path", "parts", F.when(live & F.col("_c").isNotNull(), F.col("_c")).otherwise(F.col("here")).alias("here"),
                state.alias("status"), F.when(live, F.lit(k)).otherwise(F.col("at")).alias("at"),
            F.when(live, F.col("_t")).otherwise(F.col("ttype")).alias("ttype"), F.when(live, F.col("_c")).otherwise(F.col("comodel")).alias("comodel"),
        )
    done = now if stopped is None else stopped.unionByName(now)
    return done.select("model", "path", "status", "at", "ttype", "comodel")


def topological_order(names: Sequence[str], depends: dict[str, Sequence[str]]) -> list[str]:
    """Kahn's order of a module list held on the driver: a queue seeded and fed in name order; cycles come last by name.

    Dependencies outside ``names`` don't count. The list is one repository's modules, so it is small by nature.
    """
    inside = set(names)
    needs = {n: {d for d in depends.get(n, ()) if d in inside} for n in inside}
    users: dict[str, list[str]] = {n: [] for n in inside}
    for n, ds in needs.items():
        for d in ds:
            users[d].append(n)
    waiting = {n: len(ds) for n, ds in needs.items()}
    queue = sorted(n for n, k in waiting.items() if k == 0)
    out: list[str] = []
    while len(out) < len(queue):
        n = queue[len(out)]
        out.append(n)
        for u in sorted(users[n]):
            waiting[u] -= 1
            if waiting[u] == 0:
                queue.append(u)
    return out + sorted(inside - set(out))


def levels(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, level): the longest chain of dependencies below each name, by peeling; names on or above cycles have no level.

    ``left`` has each name with edges to names that have no level yet. Names without such edges are peeled, and their edges go.
    """
    step = cut(edges.select("src", "dst").distinct().join(shuffled(names.select(F.col("name").alias("dst"))), "dst", "left_semi").join(
        shuffled(names.select(F.col("name").alias("src"))), "src", "left_semi"))
    left, done, k = cut(names.select("name").distinct()), None, 0
    while True:
        fresh = left.join(shuffled(step.select(F.col("src").alias("name")).distinct()), "name", "left_anti").select("name", F.lit(k).alias("level"))
        if done is None:
            done = Growing(fresh)
        elif not done.add(fresh):
            return done.all()
        peeled = shuffled(done.last().select("name"))
        left = cut(left.join(peeled, "name", "left_anti"))
        step = cut(step.join(peeled.withColumnRenamed("name", "dst"), "dst", "left_anti"))
        k += 1


def chain(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(start, name, depth) upwards along ``parents`` (name, parent); the start has depth 0, cycles end. Depth d takes about log2(d) rounds."""
    return reach(starts.select("start"), parents.select(F.col("name").alias("src"), F.col("parent").alias("dst")))


def would_cycle(changes: DataFrame, parents: DataFrame) -> DataFrame:
    """``changes`` (name, new_parent) with ``cycle``: whether the name is the new parent or one of its ancestors."""
    above = chain(changes.select(F.col("new_parent").alias("start")).distinct(), parents).select(F.col("start").alias("new_parent"), "name",
        F.lit(True).alias("_hit"))
    return changes.join(above, ["new_parent", "name"], "left").select("name", "new_parent", F.coalesce("_hit", F.lit(False)).alias("cycle"))


def descendant_conflicts(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name, version): descendants of a root whose version differs from the root's. ``nodes``: name, parent, version."""
    down = nodes.select(F.col("parent").alias("src"), F.col("name").alias("dst"))
    below = reach(roots.select(F.col("root").alias("start")), down).filter("depth > 0").select(F.col("start").alias("root"), "name")
    mine = nodes.select(F.col("name").alias("root"), F.col("version").alias("_own"))
    return below.join(nodes.select("name", "version"), "name").join(mine, "root").filter(F.col("version") != F.col("_own")).select("root", "name", "version")


def dependents_outside(modules: DataFrame, depends: DataFrame, changed: DataFrame) -> DataFrame:
    """Repositories with a module outside the changed set that depends on a changed one. ``modules``: name, repo."""
    users = depends.join(changed.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name")).distinct()
    return modules.join(users, "name", "left_semi").join(changed.select("name"), "name", "left_anti").select("repo").distinct()
