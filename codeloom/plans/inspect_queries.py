"""Pages of methods, extenders, views, components, templates, patches and tests bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, inspect
from .graph_queries import _EDITION_SQL, EDITIONS, ER, edges, starts, tags_sql
from .registry import Tables, query


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


_METHOD_SQL = f"""d AS (SELECT DISTINCT l_partkey AS model, 'do_' || (l_suppkey % 30) AS name, 'm' || (l_suppkey % 7) AS module, {_EDITION_SQL.format('l_suppkey % 5')} AS edition FROM lineitem)"""


@query(f"""{tags_sql(3, "'INHERITS'")}, {_METHOD_SQL},
  n AS (SELECT a.start, d.name, a.name AS owner, d.module FROM a JOIN d ON d.model = a.name WHERE contains(d.name, '_1') QUALIFY row_number() OVER (PARTITION BY a.start, d.name ORDER BY a.depth, {ER}, d.module, a.name) = 1),
  o AS (SELECT model AS owner, name, count(DISTINCT module) >= 2 AS overridden FROM d GROUP BY ALL),
  p AS (SELECT n.*, overridden, row_number() OVER (PARTITION BY start ORDER BY name) - 1 AS place, count(*) OVER (PARTITION BY start) AS total FROM n JOIN o USING (owner, name))
  SELECT start, name, owner, module, overridden, CAST(place AS INTEGER) AS place, total FROM p WHERE place BETWEEN 2 AND 5""")
def methods_page(t: Tables) -> DataFrame:
    """The second page of every model's methods whose name holds a part, inherited ones from the nearest owner."""
    s = F.col("l_suppkey")
    d = t.lineitem.select(F.col("l_partkey").alias("model"), F.concat(F.lit("do_"), s % 30).alias("name"), F.concat(F.lit("m"), s % 7).alias("module"), _pick(EDITIONS, s).alias("edition")).distinct()
    return inspect.methods_listing(graph.ancestors(starts(t), edges(t), kinds=(graph.INHERITS,)), d, "_1", 2, 4)


@query(f"""WITH m AS (SELECT l_partkey AS model, l_returnflag AS version, l_suppkey AS module, bool_or(l_linenumber = 1) AS is_definition, count(*) AS field_count, CAST(sum(l_quantity) AS BIGINT) % 5 AS dependents, {_EDITION_SQL.format('l_suppkey % 5')} AS edition FROM lineitem GROUP BY 1, 2, 3),
  p AS (SELECT *, row_number() OVER (PARTITION BY model, version ORDER BY field_count DESC, dependents DESC, {ER}, module) - 1 AS place, count(*) OVER (PARTITION BY model, version) AS total FROM m WHERE NOT is_definition)
  SELECT model, version, module, field_count, dependents, CAST(place AS INTEGER) AS place, total FROM p WHERE place < 3""")
def extenders_page(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_partkey").alias("model"), F.col("l_returnflag").alias("version"), F.col("l_suppkey").alias("module")).agg(F.bool_or(F.col("l_linenumber") == 1).alias("is_definition"),
        F.count(F.lit(1)).alias("field_count"), (F.sum("l_quantity").cast("long") % 5).alias("dependents"))
    return inspect.extenders(m.withColumn("edition", _pick(EDITIONS, F.col("module"))), 0, 3).select("model", "version", "module", "field_count", "dependents", "place", "total")


_VIEWS_SQL = f"""v AS (SELECT 'x' || o_orderkey AS xmlid, ['form', 'tree', 'list', 'kanban'][o_orderkey % 4 + 1] AS type, o_custkey AS model, 'm' || (o_orderkey % 12) AS module, o_orderstatus AS version, {_EDITION_SQL.format('o_orderkey % 5')} AS edition FROM orders)"""


def _views(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(F.concat(F.lit("x"), k).alias("xmlid"), _pick(("form", "tree", "list", "kanban"), k).alias("type"), F.col("o_custkey").alias("model"), F.concat(F.lit("m"), k % 12).alias("module"), F.col("o_orderstatus").alias("version"),
        _pick(EDITIONS, k).alias("edition"))


@query(f"""WITH {_VIEWS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY model, version ORDER BY {ER}, module, xmlid) - 1 AS place, count(*) OVER (PARTITION BY model, version) AS total FROM v WHERE type IN ('tree', 'list'))
  SELECT model, version, xmlid, type, module, CAST(place AS INTEGER) AS place, total FROM p WHERE place < 200""")
def model_views_page(t: Tables) -> DataFrame:
    return inspect.views_listing(_views(t), "model", "list").select("model", "version", "xmlid", "type", "module", "place", "total")


@query(f"""WITH {_VIEWS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY module, version ORDER BY {ER}, module, xmlid) - 1 AS place, count(*) OVER (PARTITION BY module, version) AS total FROM v)
  SELECT module, version, xmlid, type, CAST(place AS INTEGER) AS place, total FROM p WHERE place BETWEEN 10 AND 29""")
def module_views_page(t: Tables) -> DataFrame:
    return inspect.views_listing(_views(t), "module", None, 10, 20).select("module", "version", "xmlid", "type", "place", "total")


@query("""WITH c AS (SELECT 'm' || (p_partkey % 9) AS module, 'v' || (p_size % 2) AS version, 'Comp' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'part.line' ELSE 'part' END AS bound_model, 'web.T' || p_partkey AS template FROM part),
  p AS (SELECT *, row_number() OVER (PARTITION BY module, version ORDER BY name) - 1 AS place, count(*) OVER (PARTITION BY module, version) AS total FROM c WHERE bound_model = 'part.line')
  SELECT module, version, name, template, CAST(place AS INTEGER) AS place, total FROM p WHERE place < 200""")
def components_page(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    c = t.part.select(F.concat(F.lit("m"), k % 9).alias("module"), F.concat(F.lit("v"), F.col("p_size") % 2).alias("version"), F.concat(F.lit("Comp"), k).alias("name"),
        F.when(k % 3 == 0, "part.line").otherwise("part").alias("bound_model"), F.concat(F.lit("web.T"), k).alias("template"))
    return inspect.components_listing(c, "part.line").drop("bound_model")


@query("""WITH t AS (SELECT 't' || p_partkey AS xmlid, 'm' || (p_partkey % 9) AS module, 'v' AS version, p_partkey % 7 = 0 AS unresolved FROM part),
  e AS (SELECT 't' || p_partkey AS src, 't' || (p_partkey // 2) AS dst FROM part WHERE p_partkey % 3 = 0),
  r AS (SELECT t.xmlid, t.module, t.version, u.xmlid AS parent_xmlid FROM t LEFT JOIN e ON e.src = t.xmlid LEFT JOIN t u ON u.xmlid = e.dst AND NOT u.unresolved WHERE NOT t.unresolved),
  p AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY xmlid) - 1 AS place, count(*) OVER (PARTITION BY module) AS total FROM r)
  SELECT xmlid, module, version, parent_xmlid, CAST(place AS INTEGER) AS place, total FROM p WHERE place < 200""")
def templates_page(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(F.concat(F.lit("t"), k).alias("xmlid"), F.concat(F.lit("m"), k % 9).alias("module"), F.lit("v").alias("version"), (k % 7 == 0).alias("unresolved"))
    e = t.part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("t"), k).alias("src"), F.concat(F.lit("t"), F.expr("p_partkey div 2")).alias("dst"), F.lit("v").alias("version"))
    return inspect.templates_listing(rows, e)


@query(f"""WITH j AS (SELECT o_orderstatus AS version, 'm' || (o_orderkey % 12) AS module, {_EDITION_SQL.format('o_orderkey % 12 % 5')} AS edition, ['extend', 'include', 'patch'][o_orderkey % 3 + 1] AS era, 'W' || o_custkey AS target, 'f' || o_orderkey AS patch_name FROM orders),
  p AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY {ER}, module, target, patch_name) - 1 AS place, count(*) OVER (PARTITION BY version) AS total FROM j WHERE era = 'patch')
  SELECT version, module, target, patch_name, CAST(place AS INTEGER) AS place, total FROM p WHERE place < 200""")
def patches_page(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    j = t.orders.select(F.col("o_orderstatus").alias("version"), F.concat(F.lit("m"), k % 12).alias("module"), _pick(EDITIONS, k % 12).alias("edition"), _pick(("extend", "include", "patch"), k).alias("era"),
        F.concat(F.lit("W"), F.col("o_custkey")).alias("target"), F.concat(F.lit("f"), k).alias("patch_name"))
    return inspect.patches_listing(j, "patch").select("version", "module", "target", "patch_name", "place", "total")


@query("""WITH c AS (SELECT o_orderkey AS id, 'T' || (o_orderkey % 90) AS name, 'm' || (o_custkey % 8) AS module, o_orderstatus AS version FROM orders),
  n AS (SELECT l_orderkey AS id, count(*) AS tests, CAST(sum(l_linenumber) AS BIGINT) AS asserts FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
  s AS (SELECT DISTINCT b.id FROM c a JOIN c b ON b.id = a.id // 2 WHERE a.module <> b.module),
  p AS (SELECT c.*, coalesce(tests, 0) AS tests, coalesce(asserts, 0) AS asserts, s.id IS NOT NULL AS shared, row_number() OVER (PARTITION BY module, version ORDER BY name, c.id) - 1 AS place, count(*) OVER (PARTITION BY module, version) AS total
    FROM c LEFT JOIN n ON n.id = c.id LEFT JOIN s ON s.id = c.id)
  SELECT id, name, module, version, tests, asserts, shared, CAST(place AS INTEGER) AS place, total FROM p WHERE place < 200""")
def module_tests_page(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    c = t.orders.select(k.alias("id"), F.concat(F.lit("T"), k % 90).alias("name"), F.concat(F.lit("m"), F.col("o_custkey") % 8).alias("module"), F.col("o_orderstatus").alias("version"))
    m = t.lineitem.select(F.col("l_orderkey").alias("class_id"), F.when(F.col("l_returnflag") != "N", "test_x").otherwise("helper").alias("name"), F.col("l_linenumber").cast("long").alias("asserts"))
    return inspect.module_tests(c, m, t.orders.select(k.alias("src"), F.expr("o_orderkey div 2").alias("dst")))
