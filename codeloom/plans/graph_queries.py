"""Traversals and rankings bound to graphs derived from the test tables.

Nodes are parts. INHERITS edges run from k to k div 2, DELEGATES_TO edges from k to k div 3. Members of a
model are its distinct (part, supplier) pairs in lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAGIC_FIELDS
from ..operators import diff, graph, joins, ordering, ranking, scope, store
from ..operators.lineage import shuffled, sized
from .registry import Tables, query

EDITIONS = ("community", "enterprise", "vendor", "association", "custom")
_EDITION_SQL = "CASE {} WHEN 0 THEN 'community' WHEN 1 THEN 'enterprise' WHEN 2 THEN 'vendor' WHEN 3 THEN 'association' ELSE 'custom' END"


def edges(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("src"))
    kind = lambda by, name: p.select("src", F.expr(f"src div {by}").alias("dst"), F.lit(name).alias("kind"),
        F.concat(F.lit("f"), F.col("src") % 5).alias("via_field"))
    return kind(2, graph.INHERITS).union(kind(3, graph.DELEGATES)).filter("src > 1 and dst > 0")


def members(t: Tables) -> DataFrame:
    return declared(t).distinct()


def declared(t: Tables) -> DataFrame:
    """Members with repeats."""
    s = F.col("l_suppkey")
    edition = F.element_at(F.array(*[F.lit(e) for e in EDITIONS]), (s % 5 + 1).cast("int"))
    ttype = F.element_at(F.array(*[F.lit(x) for x in ("char", "integer", "many2one", "one2many")]), (s % 4 + 1).cast("int"))
    return t.lineitem.select(F.col("l_partkey").alias("model"), F.concat(F.lit("f"), s % 40).alias("name"),
        F.concat(F.lit("m"), s % 7).alias("module"), edition.alias("edition"), ttype.alias("ttype"))


E = """e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, 'INHERITS' AS kind, 0 AS kr, 'f' || (p_partkey % 5) AS via FROM part WHERE p_partkey > 1
  UNION ALL SELECT p_partkey, p_partkey // 3, 'DELEGATES_TO', 1, 'f' || (p_partkey % 5) FROM part WHERE p_partkey > 1 AND p_partkey // 3 > 0)"""
M = f"""m AS (SELECT DISTINCT l_partkey AS model, 'f' || (l_suppkey % 40) AS name, 'm' || (l_suppkey % 7) AS module,
    {_EDITION_SQL.format('l_suppkey % 5')} AS edition,
  CASE l_suppkey % 4 WHEN 0 THEN 'char' WHEN 1 THEN 'integer' WHEN 2 THEN 'many2one' ELSE 'one2many' END AS ttype FROM lineitem)"""
ER = "CASE edition WHEN 'community' THEN 0 WHEN 'enterprise' THEN 1 WHEN 'vendor' THEN 2 WHEN 'association' THEN 3 ELSE 4 END"


def tags_sql(hops: int, kinds: str = "'INHERITS', 'DELEGATES_TO'") -> str:
    """CTEs up to ``a`` (start, name, depth, kind, via_field)."""
    out = [E, "l0 AS (SELECT p_partkey AS start, p_partkey AS name, 0 AS depth, NULL::VARCHAR AS kind, -1 AS kr, NULL::VARCHAR AS via FROM part)"]
    for d in range(1, hops + 1):
        out.append(f"l{d} AS (SELECT start, dst AS name, {d} AS depth, kind, kr, via FROM (SELECT l.start, e.dst, e.kind, e.kr, e.via, row_number() OVER (PARTITION BY l.start, e.dst ORDER BY e.kr, e.via) AS rn FROM l{d - 1} l JOIN e ON l.name = e.src WHERE e.kind IN ({kinds})) WHERE rn = 1)")
    union = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(hops + 1))
    out.append(f"a AS (SELECT start, name, depth, kind, via AS via_field FROM (SELECT *, row_number() OVER (PARTITION BY start, name ORDER BY depth, kr, via) AS rn FROM ({union})) WHERE rn = 1)")
    return "WITH " + ", ".join(out)


def starts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("start"))


@query(f"{tags_sql(3)} SELECT start, name, depth, kind, via_field FROM a")
def ancestors_3hop(t: Tables) -> DataFrame:
    return graph.ancestors(starts(t), edges(t))


_INHERITED = "SELECT start, name, owner, depth, module, edition, ttype FROM (SELECT a.start, a.name AS owner, a.depth, m.name, m.module, m.edition, m.ttype, row_number() OVER (PARTITION BY a.start, m.name ORDER BY a.depth, {er}, m.module, a.name, m.ttype) AS rn FROM a JOIN m ON a.name = m.model{where}) WHERE rn = 1"


@query(f"{tags_sql(3)}, {M} " + _INHERITED.format(er=ER, where=""))
def inherited_members(t: Tables) -> DataFrame:
    tags = graph.ancestors(starts(t), edges(t))
    return ranking.inherited_members(tags, declared(t)).select("start", "name", "owner", "depth", "module", "edition", "ttype")


#: One model, as a single request asks for it; the tables of all sizes have it.
ONE = 120


@query(f"{tags_sql(3)}, {M} " + _INHERITED.format(er=ER, where=f" WHERE a.start = {ONE}"))
def one_model_members(t: Tables) -> DataFrame:
    """A single request's form: members of one model."""
    tags, have = _one(t)
    return ranking.inherited_members(tags, have, few=True).select("start", "name", "owner", "depth", "module", "edition", "ttype")


def _one(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The one model's ancestors, and the members of these alone: the filter reaches the scan."""
    tags, names = graph.ancestors_of([ONE], edges(t))
    have = members(t)
    return tags, have if names is None else have.filter(F.col("model").isin(names))


@query(f"""{tags_sql(5, "'INHERITS'")} SELECT p.comodel, p.target, a.start IS NOT NULL AS ok FROM (SELECT {ONE}::BIGINT AS comodel, unnest([{ONE},
    {ONE // 4}, {ONE // 32}, 7])::BIGINT AS target) p LEFT JOIN a ON a.start = p.comodel AND a.name = p.target""")
def one_subtype(t: Tables) -> DataFrame:
    """A single request's form: whether one model is what four others are."""
    targets = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (ONE, ONE // 4, ONE // 32, 7)])).alias("target")
    tags, _ = graph.ancestors_of([ONE], edges(t), 5, (graph.INHERITS,))
    return graph.is_subtype(t.spark.range(ONE, ONE + 1).select(F.col("id").alias("comodel"), targets), edges(t), tags=tags)


@query(f"{tags_sql(3)}, {M} " + _INHERITED.format(er=ER, where=" WHERE m.module = 'm3'"))
def inherited_members_of_module(t: Tables) -> DataFrame:
    tags = graph.ancestors(starts(t), edges(t))
    return ranking.inherited_members(tags, declared(t), "m3").select("start", "name", "owner", "depth", "module", "edition", "ttype")


_INH = "'INHERITS'"


@query(f"{tags_sql(3, _INH)}, {M} SELECT a.start, count(DISTINCT m.name) AS n FROM a JOIN m ON a.name = m.model GROUP BY 1")
def methods_inherits_only(t: Tables) -> DataFrame:
    tags = graph.ancestors(starts(t), edges(t), kinds=(graph.INHERITS,))
    return ranking.count_members(tags, declared(t))


@query(f"{tags_sql(3)}, owners AS (SELECT start, count(*) AS n_owners, max(depth) AS deepest FROM a GROUP BY 1) SELECT * FROM owners")
def owner_names(t: Tables) -> DataFrame:
    return graph.ancestors(starts(t), edges(t)).groupBy("start").agg(F.count("name").alias("n_owners"), F.max("depth").alias("deepest"))


@query(
    f"WITH RECURSIVE {E}, r AS (SELECT p_partkey AS start, p_partkey AS name, 0 AS depth FROM part UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON r.name = e.src),"
    f" a AS (SELECT start, name, min(depth) AS depth FROM r GROUP BY 1, 2), {M}, w AS (SELECT p_partkey AS start, unnest(['f1', 'f2', 'f17', 'create_uid', 'nothing']) AS field FROM part), mg AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', '{k}')" for n, k, _ in MAGIC_FIELDS)
    + ") v(field, ttype)), c AS (SELECT w.start, w.field, CASE WHEN a.depth = 0 THEN 0 ELSE 2 END AS prio, a.depth, a.name AS owner, m.module, m.ttype FROM w JOIN a USING (start) JOIN m ON m.model = a.name AND m.name = w.field"
    " UNION ALL SELECT w.start, w.field, 1, 0, w.start, NULL, mg.ttype FROM w JOIN mg USING (field)),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY start, field ORDER BY prio, depth, CASE WHEN prio = 0 THEN NULL ELSE owner END, module, ttype) AS rn FROM c)"
    " SELECT w.start, w.field, CASE prio WHEN 0 THEN 'direct' WHEN 1 THEN 'magic' WHEN 2 THEN 'inherited' END AS step, depth, owner, module FROM w LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (start, field)"
)
def field_lookup(t: Tables) -> DataFrame:
    wanted = starts(t).select("start", F.explode(F.array(*[F.lit(x) for x in ("f1", "f2", "f17", "create_uid", "nothing")])).alias("field"))
    magic = t.spark.createDataFrame([(n, k) for n, k, _ in MAGIC_FIELDS], "name string, ttype string")
    return ranking.nearest_fields(wanted, edges(t), declared(t), magic, (graph.INHERITS, graph.DELEGATES)).drop("ttype")


@query(
    f"{tags_sql(3)}, {M}, c AS (SELECT a.depth, a.name AS owner, m.module FROM a JOIN m ON m.model = a.name WHERE a.start = {ONE} AND m.name = 'f17')"
    f" SELECT {ONE}::BIGINT AS start, 'f17' AS field, CASE WHEN depth = 0 THEN 'direct' WHEN depth > 0 THEN 'inherited' END AS step, depth, owner, module FROM (SELECT 1) LEFT JOIN (SELECT * FROM c ORDER BY depth > 0, depth, CASE WHEN depth > 0 THEN owner END, module LIMIT 1) ON true"
)
def one_field_lookup(t: Tables) -> DataFrame:
    """A single request's form: where one model has one field from."""
    tags, have = _one(t)
    wanted = tags.filter("depth = 0").select("start", F.lit("f17").alias("field"))
    magic = t.spark.createDataFrame([(n, k) for n, k, _ in MAGIC_FIELDS], "name string, ttype string")
    return ranking.field_lookup(wanted, tags, have.filter("name = 'f17'"), magic).drop("ttype")


@query(f"""WITH RECURSIVE {E}, r AS (SELECT p_partkey AS root, p_partkey AS name, 0 AS depth FROM part
  UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON r.name = e.src WHERE r.depth < 20)
  SELECT root, name, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE name <> root GROUP BY 1, 2""")
def dependency_closure(t: Tables) -> DataFrame:
    roots = t.part.select(F.col("p_partkey").alias("root"))
    return graph.closure(roots, edges(t))


@query(f"""WITH RECURSIVE {E}, r AS (SELECT p_partkey AS root, p_partkey AS name, 0 AS depth FROM part
  UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON r.name = e.src)
  SELECT root, name, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE name <> root AND name % 7 = 0 GROUP BY 1, 2""")
def reachable_in_list(t: Tables) -> DataFrame:
    roots = t.part.select(F.col("p_partkey").alias("root"))
    return store.reachable_within(roots, edges(t), t.part.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("name")))


@query(f"""{tags_sql(5, _INH)}, p AS (SELECT p_partkey AS comodel, unnest([p_partkey, p_partkey // 4, p_partkey // 32, p_partkey // 64, 3]) AS target FROM part)
  SELECT DISTINCT p.comodel, p.target, a.start IS NOT NULL AS ok FROM p LEFT JOIN a ON a.start = p.comodel AND a.name = p.target""")
def subtype_5hop(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    targets = F.array(k, F.expr("p_partkey div 4"), F.expr("p_partkey div 32"), F.expr("p_partkey div 64"), F.lit(3).cast("bigint"))
    pairs = t.part.select(k.alias("comodel"), F.explode(targets).alias("target")).distinct()
    return graph.is_subtype(pairs, edges(t))


_FIELDS_SQL = "f AS (SELECT p_partkey AS model, 'up' AS name, 'many2one' AS ttype, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey // 2 END AS comodel FROM part UNION ALL SELECT p_partkey, 'third', 'one2many', p_partkey // 3 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'size', 'integer', NULL FROM part)"
_PATHS = ("up", "up.third", "up.up.size", "size.up", "third.up.up", "...", "up.nope", "up..size")


@query(f"""WITH {_FIELDS_SQL}, p AS (SELECT p_partkey AS model, path, list_filter(string_split(path, '.'), lambda x: x <> '') AS parts FROM part,
    (SELECT unnest({list(_PATHS)}) AS path)),
  s0 AS (SELECT model, path, parts, model AS here, CASE WHEN len(parts) = 0 THEN 'missing' END AS status, 0 AS stopped_at FROM p),
  """ + ", ".join(f"""s{k + 1} AS (SELECT s.model, s.path, s.parts, CASE WHEN s.status IS NULL AND len(s.parts) > {k}
    AND f.comodel IS NOT NULL THEN f.comodel ELSE s.here END AS here,
  CASE WHEN s.status IS NOT NULL OR len(s.parts) <= {k} THEN s.status WHEN f.model IS NULL THEN 'missing' WHEN len(s.parts) = {k + 1} THEN 'ok'
    WHEN f.ttype NOT IN ('many2one', 'one2many', 'many2many') THEN 'not_relational' WHEN f.comodel IS NULL THEN 'dangling_comodel' END AS status,
  CASE WHEN s.status IS NULL AND len(s.parts) > {k} THEN {k} ELSE s.stopped_at END AS stopped_at FROM s{k} s LEFT JOIN f ON f.model = s.here
    AND s.status IS NULL AND f.name = s.parts[{k + 1}])""" for k in range(3)) + " SELECT model, path, status, stopped_at FROM s3")
def path_walk(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    up = t.part.select(k.alias("model"), F.lit("up").alias("name"), F.lit("many2one").alias("ttype"),
        F.when(k % 11 != 0, F.expr("p_partkey div 2")).alias("comodel"))
    third = t.part.filter("p_partkey % 3 = 0").select(k.alias("model"), F.lit("third").alias("name"), F.lit("one2many").alias("ttype"),
        F.expr("p_partkey div 3").alias("comodel"))
    size = t.part.select(k.alias("model"), F.lit("size").alias("name"), F.lit("integer").alias("ttype"), F.lit(None).cast("bigint").alias("comodel"))
    paths = t.part.select(k.alias("model"), F.explode(F.array(*[F.lit(p) for p in _PATHS])).alias("path"))
    return graph.walk_paths(paths, up.union(third).union(size)).select("model", "path", "status", F.col("at").alias("stopped_at"))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS start, p_partkey AS name, 0 AS depth FROM part UNION ALL SELECT u.start, u.name // 2, u.depth + 1
    FROM up u WHERE u.name // 2 > 0)
  SELECT start, name, depth FROM up""")
def recursive_chain(t: Tables) -> DataFrame:
    parents = t.part.select(F.col("p_partkey").alias("name"), F.expr("nullif(p_partkey div 2, 0)").alias("parent"))
    return graph.chain(starts(t), parents)


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS start, p_partkey AS name, 0 AS depth FROM part UNION ALL SELECT u.start, u.name // 2, u.depth + 1
    FROM up u WHERE u.name // 2 > 0)
  SELECT u.start, u.name, u.depth, l_suppkey AS repo FROM up u JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l ON l.l_partkey = u.name""")
def chain_with_repos(t: Tables) -> DataFrame:
    parents = t.part.select(F.col("p_partkey").alias("name"), F.expr("nullif(p_partkey div 2, 0)").alias("parent"))
    up = graph.chain(starts(t), parents)
    return up.join(t.lineitem.select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("repo")).distinct(), "name")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS name, (p_partkey * 7) % 100 + 1 AS new_parent FROM part),
  up AS (SELECT DISTINCT new_parent AS start, new_parent AS name FROM c UNION SELECT u.start, u.name // 2 FROM up u WHERE u.name // 2 > 0)
  SELECT c.name, c.new_parent, up.name IS NOT NULL AS cycle FROM c LEFT JOIN up ON up.start = c.new_parent AND up.name = c.name""")
def cycle_check(t: Tables) -> DataFrame:
    parents = t.part.select(F.col("p_partkey").alias("name"), F.expr("nullif(p_partkey div 2, 0)").alias("parent"))
    return graph.would_cycle(t.part.select(F.col("p_partkey").alias("name"), ((F.col("p_partkey") * 7) % 100 + 1).alias("new_parent")), parents)


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS name, p_size % 3 AS version FROM part), d AS (SELECT p_partkey AS root, p_partkey AS name FROM part
  UNION SELECT d.root, p.p_partkey FROM d JOIN part p ON p.p_partkey // 2 = d.name AND p.p_partkey > 1)
  SELECT d.root, d.name, n.version FROM d JOIN n USING (name) JOIN n r ON r.name = d.root WHERE d.name <> d.root AND n.version <> r.version""")
def descendant_conflict(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("name"), F.expr("nullif(p_partkey div 2, 0)").alias("parent"), (F.col("p_size") % 3).alias("version"))
    return graph.descendant_conflicts(nodes, t.part.select(F.col("p_partkey").alias("root")))


@query("""WITH mods AS (SELECT s_suppkey AS name, s_nationkey AS repo FROM supplier), dep AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst
    FROM supplier WHERE s_suppkey > 1), ch AS (SELECT s_suppkey AS name FROM supplier WHERE s_suppkey % 9 = 0)
  SELECT DISTINCT repo FROM mods WHERE name IN (SELECT src FROM dep WHERE dst IN (SELECT name FROM ch)) AND name NOT IN (SELECT name FROM ch)""")
def cross_repo(t: Tables) -> DataFrame:
    s = t.supplier
    dep = s.filter("s_suppkey > 1").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))
    return graph.dependents_outside(s.select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("repo")), dep,
        s.filter("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("name")))


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS name, 0 AS level FROM part WHERE p_partkey // 2 = 0 UNION ALL SELECT p.p_partkey, l.level + 1
    FROM l JOIN part p ON p.p_partkey // 2 = l.name AND p.p_partkey > 1) SELECT name, CAST(level AS INTEGER) AS level FROM l""")
def dependency_levels(t: Tables) -> DataFrame:
    e = t.part.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return graph.levels(e, t.part.select(F.col("p_partkey").alias("name")))


_ORDER_EDGES = """e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey, s_suppkey // 5 FROM supplier WHERE s_suppkey > 4
    UNION SELECT s_suppkey, (s_suppkey * 7) % 90 + 1 FROM supplier WHERE s_suppkey % 9 = 0 UNION SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 31 = 0
    UNION SELECT s_suppkey, -s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)"""


@query(f"""WITH RECURSIVE n AS (SELECT s_suppkey AS name FROM supplier), {_ORDER_EDGES}, i AS (SELECT src, dst FROM e SEMI JOIN n ON n.name = e.dst),
  q AS (SELECT 0 AS wave, name, CASE WHEN name NOT IN (SELECT src FROM i) THEN row_number() OVER (PARTITION BY name NOT IN (SELECT src FROM i) ORDER BY name) - 1 END AS place FROM n
    UNION ALL
    SELECT wave + 1, name, coalesce(place, CASE WHEN waits = 0 THEN given + row_number() OVER (PARTITION BY place IS NULL AND waits = 0 ORDER BY after, name) - 1 END)
    FROM (SELECT q.wave, q.name, any_value(q.place) AS place, count(i.dst) FILTER (WHERE d.place IS NULL) AS waits, max(d.place) AS after,
        (SELECT count(place) FROM q) AS given FROM q LEFT JOIN i ON i.src = q.name LEFT JOIN q d ON d.name = i.dst GROUP BY q.wave, q.name) WHERE wave < 40),
  l AS (SELECT name, place FROM q WHERE wave = 40)
  SELECT name AS module, coalesce(place, (SELECT count(place) FROM l) + row_number() OVER (PARTITION BY place IS NULL ORDER BY name) - 1) AS place FROM l""")
def topological_order(t: Tables) -> DataFrame:
    """All modules in Kahn's queue order over a graph with cycles, loops and dependencies that are missing; what lies on or above a cycle comes last, by name."""
    k = F.col("s_suppkey")
    s = t.supplier
    dep = s.filter("s_suppkey > 1").select(k.alias("src"), F.expr("s_suppkey div 2").alias("dst")).union(s.filter("s_suppkey > 4").select(k, F.expr("s_suppkey div 5")))
    dep = dep.union(s.filter("s_suppkey % 9 = 0").select(k, k * 7 % 90 + 1)).union(s.filter("s_suppkey % 31 = 0").select(k, k)).union(s.filter("s_suppkey % 4 = 0").select(k, -k))
    return ordering.kahn_order(dep, s.select(k.alias("name"))).select(F.col("name").alias("module"), "place")


_DECL = "SELECT l_partkey AS model, l_suppkey AS sk, count(*) AS field_count FROM lineitem GROUP BY 1, 2"


@query(f"""WITH d AS ({_DECL}), dep AS (SELECT l_suppkey AS sk, count(DISTINCT l_orderkey) AS dependents FROM lineitem GROUP BY 1),
  x AS (SELECT model, 'm' || d.sk AS module, d.sk % 3 = 0 AS is_definition, field_count, dependents, {_EDITION_SQL.format('d.sk % 5')} AS edition
    FROM d JOIN dep USING (sk))
  SELECT model, module, is_definition, field_count, dependents, edition FROM (SELECT *, row_number() OVER (PARTITION BY model
    ORDER BY is_definition DESC, field_count DESC, dependents DESC, {ER}, module) AS rn FROM x) WHERE rn = 1""")
def declaring_rank(t: Tables) -> DataFrame:
    li = t.lineitem
    n = li.count()
    by_module = sized(li.select(F.col("l_partkey").alias("model"), F.col("l_suppkey").alias("sk"), "l_orderkey"), n, "sk")
    d = by_module.groupBy("model", "sk").agg(F.count(F.lit(1)).alias("field_count"))
    dep = by_module.groupBy("sk").agg(F.count_distinct("l_orderkey").alias("dependents"))
    edition = F.element_at(F.array(*[F.lit(e) for e in EDITIONS]), (F.col("sk") % 5 + 1).cast("int"))
    x = d.join(shuffled(dep), "sk").select("model", F.concat(F.lit("m"), "sk").alias("module"), (F.col("sk") % 3 == 0).alias("is_definition"), "field_count",
        "dependents", edition.alias("edition"))
    return ranking.declaring_module(sized(x, n, "model"), ["model"])


@query(f"""WITH d AS ({_DECL}), x AS (SELECT model, 'm' || sk AS module, sk % 4 = 0 AS is_definition, field_count FROM d)
  SELECT model, module FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY is_definition DESC, field_count DESC, module) AS rn FROM x)
    WHERE rn = 1""")
def ranked_parent(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy(F.col("l_partkey").alias("model"), F.col("l_suppkey").alias("sk")).agg(F.count(F.lit(1)).alias("field_count"))
    x = d.select("model", F.concat(F.lit("m"), "sk").alias("module"), (F.col("sk") % 4 == 0).alias("is_definition"), "field_count")
    return ranking.first_by(x, ["model"], ranking.parent_order()).select("model", "module")


_PROFILE_SQL = "CASE WHEN c_custkey % 10 = 0 THEN []::VARCHAR[] WHEN c_nationkey % 3 = 0 THEN [c_mktsegment, 'N' || c_nationkey] ELSE [c_mktsegment] END"


def profiled(t: Tables) -> DataFrame:
    p = F.when(F.col("c_custkey") % 10 == 0, F.array().cast("array<string>")).when(F.col("c_nationkey") % 3 == 0,
        F.array("c_mktsegment", F.concat(F.lit("N"), "c_nationkey"))).otherwise(F.array("c_mktsegment"))
    return t.customer.withColumn("profile", p)


@query(f"WITH c AS (SELECT c_custkey, {_PROFILE_SQL} AS profile FROM customer) SELECT c_custkey FROM c WHERE len(profile) > 0 AND len(list_filter(profile, lambda x: x NOT IN ('BUILDING', 'N3', 'MACHINERY'))) = 0")
def scope_filter(t: Tables) -> DataFrame:
    return profiled(t).filter(scope.visible(F.col("profile"), ["BUILDING", "N3"], ["MACHINERY"])).select("c_custkey")


@query(f"WITH c AS (SELECT c_custkey, {_PROFILE_SQL} AS profile FROM customer) SELECT c_custkey FROM c WHERE len(profile) > 0 AND len(list_filter(profile, lambda x: x NOT IN ('BUILDING', 'MACHINERY'))) = 0")
def scope_narrowed(t: Tables) -> DataFrame:
    own, shared = scope.narrow(["BUILDING", "N3"], ["MACHINERY"], "BUILDING")
    return profiled(t).filter(scope.visible(F.col("profile"), own, shared)).select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def vector_scope(t: Tables) -> DataFrame:
    return t.customer.filter(scope.vector_visible(F.col("c_mktsegment"), scope.allowed_union(["BUILDING"], ["MACHINERY"]))).select("c_custkey", "c_mktsegment")


@query("""SELECT DISTINCT a.p_partkey AS a, b.p_partkey // 3 AS c FROM part a JOIN part b ON a.p_partkey // 2 = b.p_partkey WHERE a.p_partkey > 1
    AND b.p_partkey // 3 > 0""")
def two_hop_path(t: Tables) -> DataFrame:
    e = edges(t)
    return joins.two_hops(e.filter(F.col("kind") == graph.INHERITS), e.filter(F.col("kind") == graph.DELEGATES))


@query("""WITH h AS (SELECT p_partkey AS base FROM part WHERE p_partkey % 4 = 0), c AS (SELECT p_partkey AS base FROM part)
  SELECT p.p_partkey AS name, p.p_partkey // 2 AS base, CASE WHEN h.base IS NOT NULL THEN 'helper' ELSE 'class' END AS kind FROM part p LEFT
    JOIN h ON h.base = p.p_partkey // 2 LEFT JOIN c ON c.base = p.p_partkey // 2 WHERE h.base IS NOT NULL OR c.base IS NOT NULL""")
def inherits_test(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    classes = t.part.select(k.alias("name"), F.lit("17.0").alias("version"), F.array(F.expr("p_partkey div 2")).alias("bases"))
    every = t.part.filter("p_partkey % 2 = 0").select(k.alias("name"), F.lit("17.0").alias("version"), F.array().cast("array<bigint>").alias("bases"))
    helpers = t.part.filter("p_partkey % 4 = 0").select(k.alias("name"), F.lit("17.0").alias("version"))
    found = store.inherits_test(classes.unionByName(every), helpers)
    return found.select("name", "base", "kind")


@query("""SELECT DISTINCT e.l_partkey AS name, e.l_returnflag AS version, e.l_suppkey AS src_module, d.l_suppkey AS dst_module FROM lineitem e
    JOIN lineitem d USING (l_partkey, l_returnflag)
  WHERE d.l_suppkey % 5 = 0 AND e.l_suppkey % 5 <> 0""")
def same_name_inherits(t: Tables) -> DataFrame:
    m = t.lineitem.select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("module"), F.col("l_returnflag").alias("version"),
        (F.col("l_suppkey") % 5 == 0).alias("is_definition"))
    return store.same_name_inherits(m)


@query("""SELECT DISTINCT o_orderkey AS test, l_partkey AS model, l_suppkey AS name, 'm' || (l_suppkey % 7) AS module, o_orderpriority AS via
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey % 7 < 4""")
def coverage_edges(t: Tables) -> DataFrame:
    li = t.lineitem
    refs = li.join(t.orders, li.l_orderkey == F.col("o_orderkey")).select(F.col("o_orderkey").alias("test"), F.col("l_partkey").alias("model"),
        F.col("l_suppkey").alias("name"), F.col("o_orderpriority").alias("via"))
    mem = li.select(F.col("l_partkey").alias("model"), F.col("l_suppkey").alias("name"), F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("module"),
        (F.col("l_suppkey") % 7 < 4).alias("is_definition")).distinct()
    return store.coverage_edges(refs, mem)


@query("""SELECT o.c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.name ELSE coalesce(n.name, o.name) END AS name,
    list_sort(list_distinct(list_concat(o.tags, coalesce(n.tags, [])))) AS tags, o.flag OR coalesce(n.flag, false) AS flag FROM
  (SELECT c_custkey, c_name AS name, [c_mktsegment] AS tags, c_custkey % 2 = 0 AS flag FROM customer) o LEFT JOIN (SELECT c_custkey, CASE
    WHEN c_custkey % 6 = 0 THEN NULL ELSE upper(c_name) || '!' END AS name, ['new', c_mktsegment] AS tags, c_custkey % 3 = 0 AS flag FROM customer
    WHERE c_custkey % 3 = 0) n USING (c_custkey)""")
def upsert(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    old = t.customer.select(k, F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags"), (k % 2 == 0).alias("flag"))
    new = t.customer.filter("c_custkey % 3 = 0").select(k, F.when(k % 6 != 0, F.concat(F.upper("c_name"), F.lit("!"))).alias("name"),
        F.array(F.lit("new"), "c_mktsegment").alias("tags"), (k % 3 == 0).alias("flag"))
    return store.upsert(old, new, ["c_custkey"], ["tags"], ["flag"]).withColumn("tags", F.sort_array("tags"))


@query("""WITH n AS (SELECT * FROM orders WHERE o_custkey % 10 = 0) SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
    WHERE o_custkey NOT IN (SELECT o_custkey FROM n)
  UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
    ORDER BY o_orderkey DESC) AS rn FROM n) WHERE rn = 1""")
def vector_sink(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return store.replace_partition(o, o.filter("o_custkey % 10 = 0"), ["o_custkey"], ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("SELECT p.p_partkey AS path FROM part p WHERE p_partkey % 12 < 3")
def changed_modules(t: Tables) -> DataFrame:
    mods = t.part.select(F.col("p_partkey").alias("path"), F.concat(F.lit("addons/m"), (F.col("p_partkey") % 12).cast("string")).alias("root"))
    changed = t.spark.createDataFrame([("addons/m0/models/a.py",), ("addons/m1/__manifest__.py",), ("addons/m2/static/src/x/y.js",),
        ("addons/m99/z.py",), ("README.md",)], "path string")
    return diff.changed_modules(mods, changed).select("path")
