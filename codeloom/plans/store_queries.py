"""Sinks, post-passes, vector index, override chains and deep walks bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ann, embedding, examples, graph, history, lineage, sinks, store, tools
from .registry import Tables, query
from .text_queries import _COS
from .tool_queries import _KINDS, _NAMES, _SAFETY, fields, key, walk_sql

# Nodes are parts: kinds, versions, placeholders (module and flag), real rows with a stale flag, placeholders without it.
# Edges run to k div 2 and k div 3, some with the flag.
_KIND_NAMES = ("Model", "View", "QWebTmpl", "OWLComp", "Field")
_NODES_SQL = f"""n AS (SELECT p_partkey AS id, {list(_KIND_NAMES)}[p_partkey % 5 + 1] AS kind, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '__unresolved__'
    ELSE 'm' || (p_size % 7) END AS module, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 7 = 0 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 3 = 0 END AS unresolved FROM part),
  e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, p_partkey % 2 = 1 AS unresolved FROM part UNION ALL SELECT p_partkey, p_partkey // 3, NULL FROM part WHERE p_partkey % 2 = 0)"""
_HEAL_SQL = """hn AS (SELECT id, kind, module, version, CASE WHEN kind IN ('View', 'QWebTmpl') AND version = 'v1' AND unresolved AND coalesce(module, '') <> '__unresolved__' THEN false ELSE unresolved END AS unresolved FROM {n}),
  he AS (SELECT src, dst, CASE WHEN unresolved AND EXISTS (SELECT 1 FROM {n} t WHERE t.id = dst AND t.version = 'v1' AND coalesce(t.module, '') <> '__unresolved__') THEN false ELSE unresolved END AS unresolved FROM {e}),
  o AS (SELECT 'node' AS part, id, NULL::BIGINT AS dst, unresolved FROM hn UNION ALL SELECT 'edge', src, dst, unresolved FROM he)"""


def graph_nodes(t: Tables) -> DataFrame:
    k = key()
    kind = F.element_at(F.array(*[F.lit(x) for x in _KIND_NAMES]), (k % 5 + 1).cast("int"))
    module = F.when(k % 13 == 0, F.lit(None)).when(k % 4 == 1, store.UNRESOLVED).otherwise(F.concat(F.lit("m"), F.col("p_size") % 7))
    return t.part.select(k.alias("id"), kind.alias("kind"), module.alias("module"), F.when((k % 2 == 0) | (k % 7 == 0), "v1").otherwise("v2").alias("version"),
        F.when(k % 11 != 0, k % 3 == 0).alias("unresolved"))


def graph_edges(t: Tables) -> DataFrame:
    k = key()
    return t.part.select(k.alias("src"), F.expr("p_partkey div 2").alias("dst"), (k % 2 == 1).alias("unresolved")).union(
        t.part.filter(k % 2 == 0).select(k, F.expr("p_partkey div 3"), F.lit(None).cast("boolean")))


def _both(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("part"), "id", F.lit(None).cast("long").alias("dst"), "unresolved").union(edges.select(F.lit("edge"), "src", "dst", "unresolved"))


@query(f"""WITH {_NODES_SQL}, gone AS (SELECT id FROM n WHERE kind IN ('Model', 'View', 'QWebTmpl', 'OWLComp') AND version = 'v1' AND module = '__unresolved__' AND unresolved),
  kn AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM gone)), ke AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)),
  {_HEAL_SQL.format(n='kn', e='ke')} SELECT * FROM o""")
def gc_placeholders(t: Tables) -> DataFrame:
    """Placeholders of one version go with their edges whoever points at them; real rows that still carry the flag stay and are healed."""
    return _both(*store.gc_placeholders(graph_nodes(t), graph_edges(t), "v1"))


@query(f"WITH {_NODES_SQL}, {_HEAL_SQL.format(n='n', e='e')} SELECT * FROM o")
def heal_flags(t: Tables) -> DataFrame:
    return _both(*store.heal_flags(graph_nodes(t), graph_edges(t), "v1"))


@query("""WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version FROM part)
  SELECT id, version FROM b WHERE version <> 'v1' OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 6 = id) OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 40 = 1 AND (o_orderkey = id OR o_custkey = id))
    OR EXISTS (SELECT 1 FROM customer WHERE c_custkey // 10 * 10 = id AND c_nationkey < 3)""")
def gc_bundles(t: Tables) -> DataFrame:
    bundles = t.part.select(key().alias("id"), F.when(key() % 2 == 0, "v1").otherwise("v2").alias("version"))
    contributes = t.supplier.select(F.col("s_suppkey").alias("module"), (F.col("s_suppkey") * 6).alias("bundle"))
    includes = t.orders.filter("o_orderkey % 40 = 1").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    extends = t.customer.filter("c_nationkey < 3").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 10 * 10").alias("dst"))
    return store.gc_bundles(bundles, contributes, includes, extends, "v1")


@query("""WITH m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 3 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey END AS repo_id FROM customer),
  e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer), g AS (SELECT id FROM m WHERE version = 'v1' AND repo_id IS NULL AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
  SELECT 'module' AS part, id, NULL::BIGINT AS dst FROM m WHERE id NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'edge', src, dst FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)""")
def gc_dep_stubs(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    m = t.customer.select(k.alias("id"), F.when(k % 5 < 3, "v1").otherwise("v2").alias("version"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("repo_id"))
    e = t.customer.select(k.alias("src"), F.expr("c_custkey div 2").alias("dst"))
    left, edges = store.gc_dep_stubs(m, t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("module")), e, "v1")
    return left.select(F.lit("module").alias("part"), "id", F.lit(None).cast("long").alias("dst")).union(edges.select(F.lit("edge"), "src", "dst"))


@query(f"""WITH {_NODES_SQL}, m AS (SELECT -s_suppkey AS id, 'm' || (s_suppkey % 7) AS name, 'r' || (s_nationkey % 4) AS repo, CASE WHEN s_suppkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS version FROM supplier WHERE s_suppkey <= 7),
  gm AS (SELECT * FROM m WHERE repo = 'r1' AND version = 'v1'),
  gn AS (SELECT n.id FROM n WHERE (module, version) IN (SELECT (name, version) FROM gm)),
  x AS (SELECT src, dst FROM e UNION ALL SELECT p_partkey, -(p_partkey % 7 + 1) FROM part)
  SELECT 'module' AS part, id, NULL::BIGINT AS dst FROM m WHERE id NOT IN (SELECT id FROM gm) UNION ALL SELECT 'node', id, NULL FROM n WHERE id NOT IN (SELECT id FROM gn)
  UNION ALL SELECT 'edge', src, dst FROM x WHERE src NOT IN (SELECT id FROM gm UNION ALL SELECT id FROM gn) AND dst NOT IN (SELECT id FROM gm UNION ALL SELECT id FROM gn)""")
def scoped_delete(t: Tables) -> DataFrame:
    """A repository's modules of one version go, with what is defined in them and all edges."""
    s = F.col("s_suppkey")
    m = t.supplier.filter("s_suppkey <= 7").select((-s).alias("id"), F.concat(F.lit("m"), s % 7).alias("name"), F.concat(F.lit("r"), F.col("s_nationkey") % 4).alias("repo"),
        F.when(s % 3 == 0, "v2").otherwise("v1").alias("version"))
    x = graph_edges(t).select("src", "dst").union(t.part.select(key(), -(key() % 7 + 1)))
    modules, nodes, edges = store.delete_repo(m, graph_nodes(t), x, "r1", "v1")
    none = F.lit(None).cast("long")
    return modules.select(F.lit("module").alias("part"), "id", none.alias("dst")).union(nodes.select(F.lit("node"), "id", none)).union(edges.select(F.lit("edge"), "src", "dst"))


@query("""WITH c AS (SELECT p_partkey AS id, 'T' || (p_partkey % 200) AS name, 'm' || (p_size % 4) AS module, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 3 <> 0 END AS bare, p_partkey % 50 = 7 AS was,
    ['p' || (p_partkey % 2)] AS profile FROM part), u AS (SELECT DISTINCT p_partkey // 4 AS id FROM part),
  k AS (SELECT c.*, coalesce(bare AND u.id IS NOT NULL, false) OR was AS helper FROM c LEFT JOIN u USING (id)),
  h AS (SELECT name, module, list_sort(list(DISTINCT p)) AS profile FROM (SELECT name, module, unnest(profile) AS p FROM k WHERE helper) GROUP BY ALL),
  o AS (SELECT 'T' || s_suppkey AS name, 'm' || (s_suppkey % 4) AS module, 'framework' AS origin, ['base'] AS profile FROM supplier WHERE s_suppkey < 40)
  SELECT 'class' AS part, id, name, module, CAST(helper AS VARCHAR) AS what, NULL AS profiles FROM k
  UNION ALL SELECT 'helper', NULL, name, module, CASE WHEN h.name IS NULL THEN origin ELSE 'addon' END, array_to_string(list_concat(coalesce(o.profile, []), list_filter(coalesce(h.profile, []), lambda x: x <> 'base')), ',') FROM o FULL JOIN h USING (name, module)""")
def promote_helpers(t: Tables) -> DataFrame:
    """Classes that others derive from and that have no tests of their own become helpers; helpers that are there join the profiles, old names first."""
    k = key()
    c = t.part.select(k.alias("id"), F.concat(F.lit("T"), k % 200).alias("name"), F.concat(F.lit("m"), F.col("p_size") % 4).alias("module"), F.lit("v").alias("version"),
        F.when(k % 9 != 0, k % 3 != 0).alias("defines_no_test_methods"), (k % 50 == 7).alias("is_helper"), F.array(F.concat(F.lit("p"), k % 2)).alias("profile"))
    s = F.col("s_suppkey")
    old = t.supplier.filter("s_suppkey < 40").select(F.concat(F.lit("T"), s).alias("name"), F.concat(F.lit("m"), s % 4).alias("module"), F.lit("v").alias("version"),
        F.lit("framework").alias("origin"), F.array(F.lit("base")).alias("profile"))
    classes, helpers = store.promote_helpers(c, t.part.select(k.alias("src"), F.expr("p_partkey div 4").alias("dst")), old)
    none = F.lit(None)
    return classes.select(F.lit("class").alias("part"), "id", "name", "module", F.col("is_helper").cast("string").alias("what"), none.cast("string").alias("profiles")).union(
        helpers.select(F.lit("helper"), none.cast("long"), "name", "module", "origin", F.concat_ws(",", "profile")))


# sinks


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT *, CASE WHEN o_custkey % 20 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_custkey % 10 = 0),
  l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM n), g AS (SELECT o_orderkey, o_custkey, o_orderpriority, v FROM l WHERE rn = 1 AND v IS NOT NULL)
  SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice AS v FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM g) UNION ALL SELECT * FROM g""")
def vector_sink_written(t: Tables) -> DataFrame:
    """Two commits to a written table: some scopes are replaced, those whose rows all lack a vector keep their old rows."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    table = sinks.SnapshotTable(t.spark, lineage.fresh_folder(o), "o_orderkey long, o_custkey long, o_orderpriority string, v double", ["o_custkey"])
    args = ("v", ["o_custkey", "o_orderpriority"], "o_orderkey")
    table.rewrite(o.filter("o_orderkey % 2 = 0"), lambda old, new: new)
    new = o.filter("o_custkey % 10 = 0").withColumn("v", F.when((F.col("o_custkey") % 20 != 0) & (F.col("o_orderkey") % 5 != 0), F.col("v")))
    sinks.write_vectors(table, new, *args)
    sinks.write_vectors(table, new, *args)  # a repeated write changes nothing
    return table.read()


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 3 <> 0 THEN c_name ELSE upper(c_name) END AS name, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'new' THEN [c_mktsegment, 'new'] ELSE [c_mktsegment] END AS tags,
    c_custkey % 2 = 0 OR c_custkey % 9 = 0 AS flag FROM customer""")
def graph_sink_written(t: Tables) -> DataFrame:
    """Keyed upserts into a written table: values where set, tags only grow (old ones first, order kept), flags stay true."""
    k = F.col("c_custkey")
    rows = t.customer.select(k, "c_nationkey", F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags"), (k % 2 == 0).alias("flag"))
    table = sinks.SnapshotTable(t.spark, lineage.fresh_folder(rows), "c_custkey long, c_nationkey int, name string, tags array<string>, flag boolean", ["c_nationkey"], 16)
    args = (["c_custkey", "c_nationkey"], ["tags"], ["flag"])
    sinks.write_graph(table, rows, *args)
    new = rows.filter("c_custkey % 3 = 0").withColumns({"name": F.when(k % 6 != 0, F.upper("name")), "tags": F.array(F.lit("new")), "flag": k % 9 == 0})
    sinks.write_graph(table, new, *args)
    sinks.write_graph(table, new, *args)
    return table.read()


_DIGEST = "list_transform(range(16), lambda i: (strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1 - 127.5)"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, md5(coalesce(text, '')) AS h FROM documents), v AS (SELECT doc_id, x, CAST({_DIGEST} AS DOUBLE[]) AS v FROM d)
  SELECT doc_id, length(x) BETWEEN 1 AND 2048 AS embedded, CASE WHEN length(x) BETWEEN 1 AND 2048 THEN round(CAST(CAST(v[1] / sqrt(list_dot_product(v, v)) AS FLOAT) AS DOUBLE), 5) END AS first,
    CASE WHEN length(x) BETWEEN 1 AND 2048 THEN round(CAST(CAST(v[16] / sqrt(list_dot_product(v, v)) AS FLOAT) AS DOUBLE), 5) END AS last FROM v""")
def embedded_documents(t: Tables) -> DataFrame:
    """All documents through the ladder with the stand-in backend: long ones are refused, and cost only themselves."""
    e = embedding.embed_rows(t.documents.select("doc_id", "text"), lambda: embedding.DigestBackend(2048), "text")
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 5)
    return e.select("doc_id", F.col("embedding").isNotNull().alias("embedded"), at(0).alias("first"), at(15).alias("last"))


# vector index


def _asked(t: Tables) -> DataFrame:
    """The stated query set: rows whose id divides by 100."""
    return t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query(f"""WITH h AS (SELECT b.vec_id AS query, a.vec_id, {_COS} AS cos FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 WHERE a.label = 3 AND a.vec_id % 7 < 2)
  SELECT query, vec_id, CAST(row_number() OVER (PARTITION BY query ORDER BY cos DESC, vec_id) AS INTEGER) AS place FROM h QUALIFY place <= 20""")
def filtered_search(t: Tables) -> DataFrame:
    """The index under a narrow filter, widened until every query has its 20 nearest rows: equal to exact search."""
    index = ann.build_index(t.embeddings, 24, "vec_id")
    found, _ = ann.search_until_full(index, _asked(t), 20, (F.col("label") == 3) & (F.col("vec_id") % 7 < 2))
    return found.select("query", "vec_id", "place")


@query()
def indexed_recall(t: Tables) -> DataFrame:
    """How many of the true 20 nearest the index finds for every query, in as many lists as other rows' queries needed for a recall of 0.95."""
    index = ann.build_index(t.embeddings, 24, "vec_id")
    others = t.embeddings.filter("vec_id % 100 = 50 or vec_id % 100 = 25").select(F.col("vec_id").alias("query"), "embedding")
    probes = ann.probes_for(index, others, 20)
    return ann.recall(ann.search(index, _asked(t), 20, probes), ann.exact(t.embeddings, _asked(t), 20, "vec_id"), "vec_id").withColumn("probes", F.lit(probes))


# overrides and deep walks

_METHODS_SQL = f"""m AS (SELECT l_partkey AS model, {list(_NAMES)}[l_linenumber + 1] AS name, 'v' || (l_orderkey % 2) AS version, 'm' || (l_suppkey % 9) AS module, CASE WHEN l_suppkey % 3 = 0 THEN 'ee' END AS edition, l_returnflag = 'R' AS has_super,
    l_linenumber AS i FROM lineitem)"""


def _methods(t: Tables) -> DataFrame:
    s = F.col("l_suppkey")
    return t.lineitem.select(F.col("l_partkey").alias("model"), F.element_at(F.array(*[F.lit(n) for n in _NAMES]), F.col("l_linenumber") + 1).alias("name"),
        F.concat(F.lit("v"), F.col("l_orderkey") % 2).alias("version"), F.concat(F.lit("m"), s % 9).alias("module"), F.when(s % 3 == 0, "ee").alias("edition"), (F.col("l_returnflag") == "R").alias("has_super"))


@query(f"""WITH {_METHODS_SQL} SELECT model, name, version, {list(_KINDS)}[any_value(i) + 1] AS kind, {list(_SAFETY)}[any_value(i) + 1] AS super_safety, false AS return_required, count(*) FILTER (WHERE has_super) AS with_super,
    string_agg(module || coalesce('/' || edition, '') || '/' || has_super, ' ' ORDER BY module, edition NULLS FIRST, has_super) AS chain FROM m GROUP BY model, name, version""")
def override_points(t: Tables) -> DataFrame:
    """Every method with its convention and its chain by module; a method of one module is a chain of one."""
    link = lambda x: F.concat_ws("/", x["module"], x["edition"], x["has_super"].cast("string"))
    return tools.override_points(_methods(t)).withColumn("chain", F.array_join(F.transform("chain", link), " "))


@query(f"""WITH {_METHODS_SQL}, c AS (SELECT model, name, version, list_sort(list(DISTINCT module)) AS ms, any_value(i) AS i FROM m GROUP BY ALL),
  j AS (SELECT model, name, a.ms AS o, b.ms AS n, coalesce(a.i, b.i) AS i FROM (SELECT * FROM c WHERE version = 'v0') a FULL JOIN (SELECT * FROM c WHERE version = 'v1') b USING (model, name))
  SELECT model, name, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN o = n THEN 'same' ELSE 'changed' END AS change, array_to_string(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x)), ' ') AS added,
    array_to_string(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(n, []), x)), ' ') AS removed, {list(_KINDS)}[i + 1] AS kind, {list(_SAFETY)}[i + 1] AS super_safety FROM j""")
def override_diff(t: Tables) -> DataFrame:
    d = tools.override_diff(tools.override_points(_methods(t)), "v0", "v1")
    return d.withColumns({c: F.array_join(c, " ") for c in ("added", "removed")})


_LONG = ("up.up.up.up.up.up.up.size", "up.third.up.third.up.up.size", "up.up.up.up.up.up.up.up.up.up.up.up", "up.up.up.up.up.up.nope.up", "size.up.up.up.up.up.up")


@query(f"""WITH {walk_sql(f"SELECT p_partkey AS model, path, string_split(path, '.') AS parts FROM part, (SELECT unnest({list(_LONG)}) AS path)", 12)} SELECT model, path, status FROM s12""")
def deep_paths(t: Tables) -> DataFrame:
    """Paths of up to twelve parts: every part is walked."""
    paths = t.part.select(key().alias("model"), F.explode(F.array(*[F.lit(p) for p in _LONG])).alias("path"))
    return graph.walk_paths(paths, fields(t)).select("model", "path", "status")


# incremental ingest. Repositories are customers' tens; a commit's parent is ten before it, every seventh merges one thirty before; at 110 a history is broken off

_HEADS_SQL = """c AS (SELECT c_custkey % 10 AS repo, c_custkey AS sha, c_custkey - 10 AS parent FROM customer WHERE c_custkey % 110 <> 0 UNION ALL SELECT c_custkey % 10, c_custkey, c_custkey - 30 FROM customer WHERE c_custkey % 70 = 0),
  m AS (SELECT c_custkey % 10 AS repo, max(c_custkey) AS new FROM customer GROUP BY 1), h AS (SELECT repo, new, CASE repo WHEN 1 THEN new WHEN 2 THEN NULL WHEN 3 THEN -5 ELSE new - 10 * (repo + 3) END AS old FROM m)"""
_TREES_SQL = """f AS (SELECT p_partkey % 10 AS repo, 'addons/m' || (p_partkey % 40) || CASE WHEN p_partkey % 3 = 0 THEN '/models/' WHEN p_partkey % 40 = 8 THEN '/' ELSE '/sub/' END AS dir, p_partkey AS k, p_size FROM part),
  mf AS (SELECT DISTINCT repo, 'addons/m' || (k % 40) || '/__manifest__.py' AS path, 0 AS blob FROM f WHERE k % 40 <> 9 UNION ALL SELECT DISTINCT repo, 'addons/m' || (k % 40) || '/sub/__openerp__.py', 0 FROM f WHERE k % 40 = 16),
  ot AS (SELECT repo, dir || k || '.py' AS path, p_size AS blob FROM f WHERE k % 97 <> 5 UNION ALL SELECT * FROM mf), nt AS (SELECT repo, dir || k || '.py' AS path, p_size + CASE WHEN k % 89 = 7 THEN 1 ELSE 0 END AS blob FROM f WHERE k % 101 <> 3 UNION ALL SELECT * FROM mf)"""


def _trees(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = key()
    folder = F.concat(F.lit("addons/m"), k % 40, F.when(k % 3 == 0, "/models/").when(k % 40 == 8, "/").otherwise("/sub/"))
    f = t.part.select((k % 10).alias("repo"), F.concat(folder, k, F.lit(".py")).alias("path"), F.col("p_size").alias("blob"), k.alias("k"))
    manifest = lambda keep, end: t.part.filter(keep).select((k % 10).alias("repo"), F.concat(F.lit("addons/m"), k % 40, F.lit(end)).alias("path"), F.lit(0).alias("blob")).distinct()
    both = manifest(k % 40 != 9, "/__manifest__.py").union(manifest(k % 40 == 16, "/sub/__openerp__.py"))
    new = f.filter("k % 101 <> 3").withColumn("blob", F.col("blob") + (F.col("k") % 89 == 7).cast("int"))
    return f.filter("k % 97 <> 5").drop("k").union(both), new.drop("k").union(both)


def _history(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    parents = F.when(k % 110 == 0, F.when(k % 70 == 0, F.array(k - 30)).otherwise(F.array().cast("array<long>"))).when(k % 70 == 0, F.array(k - 10, k - 30)).otherwise(F.array(k - 10))
    commits = t.customer.select((k % 10).alias("repo"), k.alias("sha"), parents.alias("parents"))
    new = t.customer.groupBy((k % 10).alias("repo")).agg(F.max(k).alias("new"))
    old = F.when(F.col("repo") == 1, F.col("new")).when(F.col("repo") == 3, F.lit(-5)).when(F.col("repo") != 2, F.col("new") - 10 * (F.col("repo") + 3))
    return new.withColumn("old", old), commits


@query(f"""WITH RECURSIVE {_HEADS_SQL}, up AS (SELECT repo, new AS sha FROM h UNION SELECT up.repo, c.parent FROM up JOIN c ON c.repo = up.repo AND c.sha = up.sha)
  SELECT repo, CASE WHEN old = new THEN 'skip' WHEN old IN (SELECT c_custkey FROM customer) AND EXISTS (SELECT 1 FROM up WHERE up.repo = h.repo AND up.sha = h.old) THEN 'incremental' ELSE 'full' END AS mode FROM h""")
def ingest_modes(t: Tables) -> DataFrame:
    """Skip, incremental or full by the history of each repository."""
    heads, commits = _history(t)
    return history.ingest_plan(heads, commits, *_trees(t))[0]


@query(f"""WITH RECURSIVE {_HEADS_SQL}, up AS (SELECT repo, new AS sha FROM h UNION SELECT up.repo, c.parent FROM up JOIN c ON c.repo = up.repo AND c.sha = up.sha), {_TREES_SQL},
  mode AS (SELECT repo, CASE WHEN old = new THEN 'skip' WHEN old IN (SELECT c_custkey FROM customer) AND EXISTS (SELECT 1 FROM up WHERE up.repo = h.repo AND up.sha = h.old) THEN 'incremental' ELSE 'full' END AS mode FROM h),
  d AS (SELECT repo, coalesce(o.path, n.path) AS path FROM ot o FULL JOIN nt n USING (repo, path) WHERE o.blob IS DISTINCT FROM n.blob),
  mods AS (SELECT DISTINCT repo, regexp_replace(path, '/[^/]*$', '') AS module FROM nt WHERE path LIKE '%\\_\\_.py' ESCAPE '\\'),
  near AS (SELECT d.repo, d.path, arg_max(m.module, length(m.module)) AS module FROM d JOIN mods m ON m.repo = d.repo AND starts_with(d.path, m.module || '/') GROUP BY ALL)
  SELECT DISTINCT near.repo, module, mode FROM near JOIN mode USING (repo) WHERE mode = 'incremental' UNION ALL SELECT repo, module, mode FROM mods JOIN mode USING (repo) WHERE mode = 'full'""")
def ingest_modules(t: Tables) -> DataFrame:
    """The modules to scan: those with a changed file, or all of a repository whose history was rewritten."""
    heads, commits = _history(t)
    return history.ingest_plan(heads, commits, *_trees(t))[1]


# example search. Chunks are documents with the vector of the same number; modules are sources, each depending on that of half its number

_CHUNKS_SQL = f"""c AS (SELECT doc_id AS id, ['method', 'field', 'css', 'scss', 'test_method'][doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 17 = 0 THEN '__unresolved__' ELSE source END AS module, 'v' || (doc_id // 5 % 2) AS version, lang AS profile,
    CASE WHEN doc_id % 5 IN (2, 3) THEN '.o_' || source || '_' || (doc_id % 7) ELSE 'action_' || lang || '_' || (doc_id % 11) END AS entity_name, CAST(doc_id % 3 AS INTEGER) AS chunk_idx, text AS content, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
  dep AS (SELECT DISTINCT source AS src, 'src' || (CAST(substr(source, 4) AS INTEGER) // 2) AS dst, v AS version FROM documents, (SELECT unnest(['v0', 'v1']) AS v) WHERE source <> 'src0'),
  dn AS (SELECT dst AS module, version, count(*) AS n FROM dep GROUP BY ALL)"""
_ASKS = (
    (1, "how are totals computed", "v1", [], None, None, 5, 3), (2, ".o_src1", "v0", ["css", "scss"], None, "src3", 20, 8), (3, "find the action_en_3 override please", "v0", [], None, None, 10, None),
    (4, "action_de_1 or action_fr_2", "v1", ["method", "field"], ["de", "en"], None, 7, None), (5, "compute", "v0", ["method"], None, "src9", 30, 21), (6, "anything", "v0", [], [], None, 5, 4), (7, "  ", "v0", [], None, None, 5, 4),
    (8, ".o_src0_4", "v1", ["scss"], ["en"], None, 3, 11),
)


def _chunk_texts(t: Tables) -> DataFrame:
    """Chunks without their vectors."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("method", "field", "css", "scss", "test_method")]), (i % 5 + 1).cast("int"))
    style = F.concat(F.lit(".o_"), F.col("source"), F.lit("_"), i % 7)
    name = F.when((i % 5).isin(2, 3), style).otherwise(F.concat(F.lit("action_"), F.col("lang"), F.lit("_"), i % 11))
    return t.documents.select(i.alias("id"), kind.alias("kind"), F.when(i % 17 == 0, store.UNRESOLVED).otherwise(F.col("source")).alias("module"),
        F.concat(F.lit("v"), F.expr("doc_id div 5") % 2).alias("version"), F.col("lang").alias("profile"), name.alias("entity_name"), (i % 3).cast("int").alias("chunk_idx"), F.col("text").alias("content"))


def _chunk_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = _chunk_texts(t).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id")
    half = F.concat(F.lit("src"), F.expr("cast(substr(source, 4) as int) div 2"))
    dep = t.documents.filter("source <> 'src0'").select(F.col("source").alias("src"), half.alias("dst"), F.explode(F.array(F.lit("v0"), F.lit("v1"))).alias("version")).distinct()
    return c, dep


def _asked_examples(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(*a[:7], a[7]) for a in _ASKS], "ask long, text string, version string, kinds array<string>, allowed array<string>, context string, k int, like long")
    return rows.join(t.embeddings.select(F.col("vec_id").alias("like"), F.col("embedding").alias("vec")), "like", "left").drop("like")


def _asks_sql() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    lists = lambda v: "NULL::VARCHAR[]" if v is None else f"{v}::VARCHAR[]"
    return ", ".join(f"({a}, '{q}', '{v}', {lists(ks)}, {lists(al)}, {text(c)}, {k}, {'NULL' if n is None else n}::BIGINT, '{r}')" for (a, q, v, ks, al, c, k, n), r in zip(_ASKS, ("s", "l", "x", "x", "s", "s", "n", "l")))


@query(f"""WITH RECURSIVE {_CHUNKS_SQL}, q AS (SELECT ask, q.text, q.version, kinds, allowed, context, least(k, 20) AS most, e.embedding AS vec, route FROM (VALUES {_asks_sql()}) q(ask, text, version, kinds, allowed, context, k, near, route) LEFT JOIN embeddings e ON e.vec_id = near),
  v AS (SELECT q.ask, q.text, q.vec, q.route, q.most, q.context, c.* FROM q JOIN c ON c.version = q.version AND (len(kinds) = 0 OR list_contains(kinds, kind)) AND (allowed IS NULL OR list_contains(allowed, profile))),
  w AS (SELECT *, 'literal' AS match, NULL::DOUBLE AS cos, row_number() OVER (PARTITION BY ask ORDER BY length(entity_name), module, chunk_idx, id) AS place FROM v WHERE route = 'l' AND contains(lower(entity_name), lower(text))
    UNION ALL SELECT *, 'lexical', NULL, row_number() OVER (PARTITION BY ask ORDER BY length(entity_name), module, chunk_idx, id) FROM v WHERE route = 'x'
      AND len(list_filter(CASE ask WHEN 3 THEN ['find', 'action_en_3', 'override'] ELSE ['action_de_1', 'action_fr_2'] END, lambda k: contains(lower(entity_name), k))) > 0
    UNION ALL SELECT * EXCLUDE (cos), 'semantic', cos, row_number() OVER (PARTITION BY ask ORDER BY cos DESC, id) FROM (SELECT *, {_COS.replace("b.embedding", "a.vec")} AS cos FROM v a WHERE vec IS NOT NULL AND route IN ('l', 's'))),
  f AS (SELECT * FROM w WHERE place <= most QUALIFY row_number() OVER (PARTITION BY ask, id ORDER BY match = 'semantic', place) = 1),
  g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ask ORDER BY match = 'semantic', place) <= most),
  r AS (SELECT DISTINCT context AS root, version, context AS name FROM q WHERE context IS NOT NULL UNION SELECT r.root, r.version, dep.dst FROM r JOIN dep ON dep.src = r.name AND dep.version = r.version),
  h AS (SELECT ask, id, match, place, CASE match WHEN 'literal' THEN 2.0 + (count(*) FILTER (WHERE match = 'literal') OVER (PARTITION BY ask) - row_number() OVER (PARTITION BY ask ORDER BY match = 'semantic', place) + 1) * 1e-6
      WHEN 'semantic' THEN cos * (1 + 0.02 * ln(coalesce(n, 0) + 1.0)) END + CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.root = g.context AND r.version = g.version AND r.name = g.module AND r.name <> r.root) THEN 0.2 ELSE 0.0 END AS score
    FROM g LEFT JOIN dn USING (module, version) WHERE module <> '__unresolved__')
  SELECT ask, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC NULLS LAST, match = 'semantic', place) AS INTEGER) AS rank, id, match, round(score, 6) AS score FROM h""")
def example_search(t: Tables) -> DataFrame:
    """Queries by every route: semantic, literal with semantic rows behind, keywords where there is no vector; scoped, capped and reranked."""
    return examples.find_examples(_asked_examples(t), *_chunk_rows(t)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_CHUNKS_SQL}, q AS (SELECT vec_id AS ask, embedding AS vec, CASE WHEN vec_id % 200 = 0 THEN 'en_' END AS model FROM embeddings WHERE vec_id % 100 = 0),
  h AS (SELECT ask, model, c.*, {_COS.replace("a.embedding", "c.embedding").replace("b.embedding", "q.vec")} AS cos FROM c, q WHERE kind = 'test_method' AND version = 'v1'),
  k AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY cos DESC, id) AS place FROM h QUALIFY place <= 10),
  s AS (SELECT *, cos * (1 + 0.02 * ln(coalesce(n, 0) + 1.0)) AS score FROM k LEFT JOIN dn USING (module, version) WHERE module <> '__unresolved__'),
  o AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, place) AS rank FROM s)
  SELECT ask, CAST(rank AS INTEGER) AS rank, id, 'semantic' AS match, round(score, 6) AS score FROM o WHERE model IS NULL OR contains(entity_name, model) OR contains(content, model)""")
def test_example_search(t: Tables) -> DataFrame:
    """Nearest tests of the stated query set; where a model is asked for, only tests that name it."""
    none = F.lit(None)
    asks = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("ask"), F.lit("how is it tested").alias("text"), F.lit("v1").alias("version"), F.array().cast("array<string>").alias("kinds"),
        none.cast("array<string>").alias("allowed"), none.cast("string").alias("context"), F.lit(10).alias("k"), F.col("embedding").alias("vec"), F.lit("form").alias("test_kind"), F.when(F.col("vec_id") % 200 == 0, "en_").alias("model"))
    return examples.find_test_examples(asks, *_chunk_rows(t), texts=_chunk_texts(t)).withColumn("score", F.round("score", 6))
