"""Whole answers, checks and scalar rules bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import joins, store, tools, validate
from ..operators import graph as walks
from ..sources import repos, spec
from .graph_queries import _FIELDS_SQL, _INHERITED, EDITIONS, ER, M, edges, starts, tags_sql
from .registry import Tables, query

def key() -> Column:
    return F.col("p_partkey")


def fields(t: Tables) -> DataFrame:
    """Three fields a model, as ``_FIELDS_SQL`` has them."""
    up = t.part.select(key().alias("model"), F.lit("up").alias("name"), F.lit("many2one").alias("ttype"),
        F.when(key() % 11 != 0, F.expr("p_partkey div 2")).alias("comodel"))
    third = t.part.filter("p_partkey % 3 = 0").select(key().alias("model"), F.lit("third").alias("name"), F.lit("one2many").alias("ttype"),
        F.expr("p_partkey div 3").alias("comodel"))
    return up.union(third).union(t.part.select(key().alias("model"), F.lit("size").alias("name"), F.lit("integer").alias("ttype"),
        F.lit(None).cast("bigint").alias("comodel")))


def walk_sql(paths: str, hops: int = 3) -> str:
    """CTEs from ``paths`` (model, path, parts) to the last step's (model, path, status)."""
    steps = [f"{_FIELDS_SQL}", f"w AS ({paths})",
        "s0 AS (SELECT model, path, parts, model AS here, CASE WHEN len(parts) = 0 THEN 'missing' END AS status FROM w)"]
    for k in range(hops):
        live = f"s.status IS NULL AND len(s.parts) > {k}"
        steps.append(
            f"""s{k + 1} AS (SELECT s.model, s.path, s.parts, CASE WHEN {live} AND f.comodel IS NOT NULL THEN f.comodel ELSE s.here END AS here,
            CASE WHEN NOT ({live}) THEN s.status WHEN f.model IS NULL THEN 'missing' WHEN len(s.parts) = {k + 1} THEN 'ok'
    WHEN f.ttype NOT IN ('many2one', 'one2many', 'many2many') THEN 'not_relational'
            WHEN f.comodel IS NULL THEN 'dangling_comodel' END AS status FROM s{k} s LEFT JOIN f ON f.model = s.here AND s.status IS NULL
    AND f.name = s.parts[{k + 1}])"""
        )
    return ", ".join(steps)


_DOMAINS = (
    "[('up', '=', 1), ('nope.x', 'in', [])]",
    "['|', ('up.up', 'child_of', 1), ('size.up', '~', 1)]",
    "[('up.size', 'parent_of', 3), 'and', ('a', 'b'), (5, 'any', 1)]",
    "not a domain",
)
_TERMS = "(0, 0, 'term', 'up', '='), (0, 1, 'term', 'nope.x', 'in'), (1, 1, 'term', 'up.up', 'child_of'), (1, 2, 'term', 'size.up', '~'), (2, 0, 'term', 'up.size', 'parent_of'), (2, 1, 'word', NULL, NULL), (2, 2, 'malformed', NULL, NULL), (2, 3, 'no_path', NULL, 'any'), (3, -1, 'unreadable', NULL, NULL)"
_VERSIONS = ("8.0", "9.0", "17.0", "19.0", "main")


@query(f"""WITH d AS (SELECT * FROM (VALUES {_TERMS}) v(d, idx, kind, path, operator)),
  x AS (SELECT p_partkey AS id, p_partkey AS model, {list(_VERSIONS)}[p_partkey % 5 + 1] AS version, idx, kind, path, operator FROM part
    JOIN d ON d.d = p_partkey % 4),
  {walk_sql("SELECT DISTINCT model, path, string_split(path, '.') AS parts FROM x WHERE kind = 'term'")}
  SELECT x.id, x.idx, x.path, x.operator, nullif(concat_ws(',', CASE WHEN kind <> 'term' THEN kind WHEN status <> 'ok' THEN status END,
    CASE WHEN kind IN ('term', 'no_path') AND NOT (operator IN ('=', 'in', 'child_of') OR operator = 'parent_of'
    AND version <> '8.0' OR operator = 'any' AND version NOT IN ('8.0', '9.0')) THEN 'unknown_operator' END), '') AS problem
  FROM x LEFT JOIN s3 USING (model, path)""")
def domain_check(t: Tables) -> DataFrame:
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (key() % k + 1).cast("int"))
    d = t.part.select(key().alias("id"), key().alias("model"), pick(_VERSIONS, 5).alias("version"), pick(_DOMAINS, 4).alias("domain"))
    return validate.check_domains(d, fields(t)).withColumnRenamed("at", "idx")


@query(f"""WITH x AS (SELECT p_partkey AS model, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['up.size', 'up.id', 'nope'] ELSE ['third', 'up.up.third',
    'size.x'] END) AS path FROM part),
  {walk_sql("SELECT DISTINCT model, path, string_split(path, '.') AS parts FROM x")}
  SELECT model, '_compute_x' AS name, path AS dependency, CASE WHEN list_contains(parts, 'id') THEN 'depends_on_id'
    WHEN status <> 'ok' THEN status END AS problem FROM s3""")
def depends_check(t: Tables) -> DataFrame:
    even, odd = F.array(*[F.lit(x) for x in ("up.size", "up.id", "nope")]), F.array(*[F.lit(x) for x in ("third", "up.up.third", "size.x")])
    m = t.part.select(key().alias("model"), F.lit("_compute_x").alias("name"), F.when(key() % 2 == 0, even).otherwise(odd).alias("depends"))
    return validate.check_depends(m.union(m), fields(t))


_INH = "'INHERITS'"


@query(f"""{tags_sql(5, _INH)}, {_FIELDS_SQL}, w AS (SELECT DISTINCT p_partkey AS model, unnest(['up', 'size', 'nope', 'third']) AS field,
    unnest([p_partkey // 8, 1, 1, p_partkey // 3]) AS target FROM part)
  SELECT w.model, w.field, w.target, CASE WHEN f.model IS NULL THEN 'missing' WHEN f.ttype NOT IN ('many2one', 'one2many') THEN 'not_relational'
    WHEN f.comodel IS NULL THEN 'no_comodel' WHEN f.comodel = w.target OR a.start IS NOT NULL THEN 'ok' ELSE 'mismatch' END AS status
  FROM w LEFT JOIN f ON f.model = w.model AND f.name = w.field LEFT JOIN a ON a.start = f.comodel AND a.name = w.target""")
def relation_check(t: Tables) -> DataFrame:
    pair = lambda f, target: F.struct(F.lit(f).alias("field"), target.cast("bigint").alias("target"))
    w = t.part.select(key().alias("model"), F.inline(F.array(pair("up", F.expr("p_partkey div 8")), pair("size", F.lit(1)), pair("nope", F.lit(1)),
        pair("third", F.expr("p_partkey div 3")))))
    return validate.check_relations(w, fields(t), edges(t))


@query()
def name_suggestions(t: Tables) -> DataFrame:
    """Names of a nation's suppliers for slightly wrong ones; tests hold it against the standard library's matches."""
    wrong = t.supplier.select("s_nationkey", F.concat(F.reverse(F.substring("s_name", 10, 20)), F.substring("s_name", 1, 9)).alias("name"))
    near = t.supplier.select("s_nationkey", F.regexp_replace("s_name", "pp", "p").alias("name"))
    return validate.suggest(wrong.union(near).distinct(), t.supplier.select("s_nationkey", F.col("s_name").alias("name")), "s_nationkey")


_M2 = M.replace("'f' || (l_suppkey % 40)", "CASE WHEN l_suppkey % 13 = 0 THEN 'display_name' ELSE 'f' || (l_suppkey % 40) END")
_MAGIC = ", ".join(f"('{n}', '{k}')" for n, k, _ in scalars.MAGIC_FIELDS)


@query(f"""{tags_sql(3)}, {_M2}, mg AS (SELECT * FROM (VALUES {_MAGIC}) v(name, ttype)), own AS ({_INHERITED.format(er=ER, where='')}),
  b AS (SELECT p_partkey AS start, mg.name, p_partkey AS owner, mg.ttype FROM part, mg WHERE NOT EXISTS (SELECT 1 FROM a JOIN m ON a.name = m.model
    WHERE a.start = p_partkey AND m.name = mg.name))
  SELECT start, name, owner, ttype, builtin FROM (SELECT start, name, owner, ttype, false AS builtin FROM own UNION ALL SELECT start, name, owner,
    ttype, true FROM b) WHERE name ILIKE '%e%' OR ttype = 'integer'""")
def fields_listing(t: Tables) -> DataFrame:
    rows = _members_with_display(t)
    found = tools.fields_listing(walks.ancestors(starts(t), edges(t)), rows)
    return found.filter((F.col("name").ilike("%e%")) | (F.col("ttype") == "integer")).select("start", "name", "owner", "ttype", "builtin")


def _members_with_display(t: Tables) -> DataFrame:
    """Members as in ``members``, but those of every thirteenth supplier are named ``display_name``."""
    s = F.col("l_suppkey")
    edition = F.element_at(F.array(*[F.lit(e) for e in EDITIONS]), (s % 5 + 1).cast("int"))
    ttype = F.element_at(F.array(*[F.lit(x) for x in ("char", "integer", "many2one", "one2many")]), (s % 4 + 1).cast("int"))
    name = F.when(s % 13 == 0, "display_name").otherwise(F.concat(F.lit("f"), s % 40))
    return t.lineitem.select(F.col("l_partkey").alias("model"), name.alias("name"), F.concat(F.lit("m"), s % 7).alias("module"),
        edition.alias("edition"), ttype.alias("ttype"))


@query(f"""WITH d AS (SELECT l_partkey AS model, l_suppkey AS sk, count(*) AS field_count FROM lineitem GROUP BY 1, 2),
  x AS (SELECT model, 'm' || sk AS module, sk % 3 = 0 AS is_definition, field_count FROM d),
  b AS (SELECT model, module AS declared_in FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY is_definition DESC, field_count DESC,
    module) AS rn FROM x) WHERE rn = 1),
  c AS (SELECT model, count(DISTINCT module) AS modules, count(*) FILTER (WHERE NOT is_definition) AS extenders FROM x GROUP BY 1),
  m AS (SELECT l_partkey AS model, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS fields, count(DISTINCT l_suppkey)
    FILTER (WHERE l_returnflag = 'R') AS methods FROM lineitem GROUP BY 1),
  v AS (SELECT l_partkey AS model, count(*) AS views FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
  SELECT model, declared_in, modules, extenders, coalesce(fields, 0) AS fields, coalesce(methods, 0) AS methods, coalesce(views, 0) AS views FROM b
    JOIN c USING (model) LEFT JOIN m USING (model) LEFT JOIN v USING (model)""")
def model_inspect(t: Tables) -> DataFrame:
    li = t.lineitem
    sk = F.col("l_suppkey")
    d = li.groupBy(F.col("l_partkey").alias("model"), "l_suppkey").agg(F.count(F.lit(1)).alias("field_count"))
    d = d.select("model", F.concat(F.lit("m"), sk).alias("module"), (sk % 3 == 0).alias("is_definition"), "field_count", F.lit(0).alias("dependents"),
        F.lit("custom").alias("edition"))
    m = li.select(F.col("l_partkey").alias("model"), F.when(F.col("l_returnflag") == "R", "method").otherwise("field").alias("kind"), sk.alias("name"))
    return tools.model_summary(d, m, li.filter("l_quantity > 45").select(F.col("l_partkey").alias("model")))


@query("""WITH md AS (SELECT s_suppkey AS module FROM supplier), o AS (SELECT l_suppkey AS module, count(DISTINCT l_partkey)
    FILTER (WHERE l_partkey % 3 = 0) AS defined, count(DISTINCT l_partkey) FILTER (WHERE l_partkey % 3 <> 0) AS extended FROM lineitem GROUP BY 1),
  vt AS (SELECT l_suppkey AS module, l_returnflag AS type, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2), v AS (SELECT module,
    CAST(sum(n) AS BIGINT) AS views, arg_min(type, (-n, type)) AS main_type FROM vt GROUP BY 1),
  s AS (SELECT l_suppkey AS module, count(*) AS scripts FROM lineitem WHERE l_discount > 0.08 GROUP BY 1), dep AS (SELECT s_suppkey AS src,
    s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey, s_suppkey // 5 FROM supplier WHERE s_suppkey > 4)
  SELECT module, coalesce(defined, 0) AS defined, coalesce(extended, 0) AS extended, coalesce(views, 0) AS views, main_type, coalesce(scripts,
    0) AS scripts, (SELECT count(*) FROM dep WHERE src = module) AS dependencies, (SELECT count(*) FROM dep WHERE dst = module) AS dependents
  FROM md LEFT JOIN o USING (module) LEFT JOIN v USING (module) LEFT JOIN s USING (module)""")
def module_inspect(t: Tables) -> DataFrame:
    li, sk = t.lineitem, F.col("l_suppkey").alias("module")
    models = li.select(sk, F.col("l_partkey").alias("name"), (F.col("l_partkey") % 3 == 0).alias("is_definition"))
    out = tools.module_summary(t.supplier.select(F.col("s_suppkey").alias("module")), models,
        li.filter("l_quantity > 30").select(sk, F.col("l_returnflag").alias("type")), li.filter("l_discount > 0.08").select(sk), _module_edges(t))
    return out.select("module", "defined", "extended", "views", "main_type", "scripts", "dependencies", "dependents")


def _module_edges(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    half = t.supplier.filter("s_suppkey > 1").select(k.alias("src"), F.expr("s_suppkey div 2").alias("dst"))
    return half.union(t.supplier.filter("s_suppkey > 4").select(k.alias("src"), F.expr("s_suppkey div 5").alias("dst")))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey, s_suppkey // 5
    FROM supplier WHERE s_suppkey > 4),
  r AS (SELECT s_suppkey AS root, s_suppkey AS name, 0 AS depth FROM supplier UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON r.name = e.src
    WHERE depth < 20),
  l AS (SELECT s_suppkey AS name, 0 AS level FROM supplier UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.dst = l.name)
  SELECT root, name, CAST(min(depth) AS INTEGER) AS depth, CAST(any_value(lv) AS INTEGER) AS level FROM r JOIN (SELECT name, max(level) AS lv FROM l
    GROUP BY 1) USING (name) GROUP BY 1, 2""")
def load_order(t: Tables) -> DataFrame:
    return tools.load_order(t.supplier.select(F.col("s_suppkey").alias("root")), _module_edges(t))


@query("""WITH e AS (SELECT 'model' AS kind, upper(n_name) AS name, 'a' AS module, n_nationkey AS id FROM nation UNION ALL SELECT 'view', n_name,
    'm' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'view', lower(n_name), 'b', n_nationkey FROM nation),
  w AS (SELECT DISTINCT kind, name FROM (SELECT 'model' AS kind, lower(n_name) AS name FROM nation UNION ALL SELECT 'view', lower(n_name) FROM nation
    UNION ALL SELECT 'view', r_name || '?' FROM region)),
  j AS (SELECT w.kind, w.name, e.name AS found, e.module, e.id, row_number() OVER (PARTITION BY w.kind, w.name
    ORDER BY (e.name = w.name) DESC NULLS LAST, e.module NULLS LAST, e.id) AS rn FROM w LEFT JOIN e ON e.kind = w.kind AND lower(e.name) = lower(w.name))
  SELECT kind, name, found, module, id FROM j WHERE rn = 1""")
def entity_lookup(t: Tables) -> DataFrame:
    n = t.nation
    row = lambda kind, name, module: n.select(F.lit(kind).alias("kind"), name.alias("name"), module.alias("module"), F.col("n_nationkey").alias("id"))
    e = row("model", F.upper("n_name"), F.lit("a")).union(row("view", F.col("n_name"), F.concat(F.lit("m"), "n_regionkey"))).union(
        row("view", F.lower("n_name"), F.lit("b")))
    w = n.select(F.lit("model").alias("kind"), F.lower("n_name").alias("name")).union(n.select(F.lit("view"), F.lower("n_name"))).union(
        t.region.select(F.lit("view"), F.concat("r_name", F.lit("?"))))
    return tools.entity_lookup(w.distinct(), e)


_UP = "up AS (SELECT s_suppkey AS start, s_suppkey AS name, 0 AS depth FROM supplier UNION ALL SELECT u.start, u.name // 2, u.depth + 1 FROM up u WHERE u.name // 2 > 0)"


def _profiles(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("name"), F.expr("nullif(s_suppkey div 2, 0)").alias("parent"),
        (F.col("s_nationkey") % 3).cast("string").alias("version"))


def _repos(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") % 500).alias("repo"), (F.col("c_custkey") % 90 + 1).alias("profile")).distinct()


@query(f"""WITH RECURSIVE {_UP}, r AS (SELECT DISTINCT c_custkey % 500 AS repo, c_custkey % 90 + 1 AS profile FROM customer)
  SELECT start AS profile, repo, arg_min(name, (depth, name)) AS from_profile, CAST(min(depth) AS INTEGER) AS depth FROM up
    JOIN r ON r.profile = up.name GROUP BY 1, 2""")
def profile_inspect(t: Tables) -> DataFrame:
    return tools.profile_repos(_profiles(t), _repos(t))


@query(f"""WITH RECURSIVE {_UP}, r AS (SELECT DISTINCT c_custkey % 500 AS repo, c_custkey % 90 + 1 AS profile FROM customer),
    md AS (SELECT p_partkey AS name, p_partkey % 500 AS repo FROM part),
  o AS (SELECT DISTINCT start AS profile, md.name FROM up JOIN r ON r.profile = up.name JOIN md USING (repo))
  SELECT profile, name, place, total FROM (SELECT profile, name, CAST(row_number() OVER (PARTITION BY profile ORDER BY name) AS INTEGER) AS place,
    count(*) OVER (PARTITION BY profile) AS total FROM o) WHERE place <= 50""")
def profile_modules(t: Tables) -> DataFrame:
    return tools.profile_modules(_profiles(t), _repos(t), t.part.select(key().alias("name"), (key() % 500).alias("repo")), 0, 80).select("profile",
        "name", "place", "total")


@query("SELECT p.s_suppkey AS name, c.s_suppkey AS child FROM supplier p LEFT JOIN supplier c ON c.s_suppkey // 2 = p.s_suppkey AND c.s_suppkey > 1")
def children_profiles(t: Tables) -> DataFrame:
    return tools.children(_profiles(t))


@query("SELECT o_orderkey AS repo, s_suppkey AS profile, CAST(s_nationkey % 3 AS VARCHAR) AS version FROM orders JOIN supplier ON s_suppkey = o_custkey WHERE o_orderstatus = 'F'")
def repos_in_state(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("repo"), F.col("o_custkey").alias("profile"), F.col("o_orderstatus").alias("status"))
    return tools.repos_in_state(o, _profiles(t), "F").select("repo", "profile", "version")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 AND c_custkey % 3 <> 0")
def unclaimed_by_email(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.concat("c_mktsegment", F.lit("@x.example")).alias("email"),
        F.when(F.col("c_nationkey") % 2 == 0, "active").otherwise("ended").alias("status"), F.when(k % 3 == 0, k).alias("claimed_by"))
    return tools.unclaimed(rows, "Building@X.example").select("c_custkey")


@query("SELECT event_type AS pattern, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def newest_feedback(t: Tables) -> DataFrame:
    return tools.newest(t.events.select(F.col("event_type").alias("pattern"), "ts", "event_id"), ["pattern"], "ts", "event_id", 3).select("pattern", "event_id")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS module, l_returnflag AS kind, count(*) AS chunks, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY 1, 2")
def chunk_counts(t: Tables) -> DataFrame:
    return tools.chunk_counts(t.lineitem.select(F.col("l_suppkey").cast("string").alias("module"), F.col("l_returnflag").alias("kind"),
        F.col("l_partkey").alias("entity")))


_STYLES = (".ad", "$a", "@media", "article > p", "o-x", "&copy")


@query("""WITH c AS (SELECT page_id, 's' || page_id AS path, 'm' || (page_id % 3) AS module, CASE WHEN page_id % 2 = 0 THEN '.ad-'
    ELSE 'o-x_' END || url AS entity_name, '$a' || page_id || ': ' || url AS content FROM pages),
  h AS (SELECT q, c.*, length(CASE WHEN q = '$a' THEN content ELSE entity_name END) AS size FROM c, (SELECT unnest(['.ad', '$a', 'o-x',
    '&copy']) AS q) WHERE contains(lower(CASE WHEN q = '$a' THEN content ELSE entity_name END), lower(q))),
  b AS (SELECT q AS query, CAST(row_number() OVER (PARTITION BY q ORDER BY size, module, path) AS INTEGER) AS place, page_id, path, entity_name FROM h)
  SELECT query, place, path, entity_name, (SELECT count(*) FROM pages p WHERE p.page_id // 2 = b.page_id AND p.page_id > 1) AS importers FROM b
    WHERE place <= 5""")
def style_override(t: Tables) -> DataFrame:
    p = F.col("page_id")
    chunks = t.pages.select(F.concat(F.lit("s"), p).alias("path"), F.concat(F.lit("m"), p % 3).alias("module"),
        F.concat(F.when(p % 2 == 0, ".ad-").otherwise("o-x_"), "url").alias("entity_name"),
            F.concat(F.lit("$a"), p, F.lit(": "), "url").alias("content"), F.lit(0).alias("chunk_idx"))
    imports = t.pages.filter("page_id > 1").select(F.concat(F.lit("s"), p).alias("src"), F.concat(F.lit("s"), F.expr("page_id div 2")).alias("dst"))
    return tools.style_overrides(chunks, imports, _STYLES)


@query("""WITH c AS (SELECT c_custkey AS command, CASE WHEN c_custkey % 3 = 0 THEN 'db x' || c_custkey WHEN c_custkey % 3 = 1 THEN 'db' || c_custkey
    ELSE 'db' || (c_custkey - 1) || ' sub' || c_custkey END AS name FROM customer),
  f AS (SELECT DISTINCT o_custkey AS command, '--' || o_orderpriority AS flag FROM orders)
  SELECT name, coalesce((SELECT list_sort(list(flag)) FROM f WHERE f.command = c.command), []) AS flags, coalesce((SELECT list_sort(list(s.name))
    FROM c s WHERE starts_with(s.name, c.name || ' ')), []) AS subcommands, NOT contains(name, ' ') AS top FROM c""")
def command_help(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("db x"), k)).when(k % 3 == 1, F.concat(F.lit("db"), k)).otherwise(F.concat(F.lit("db"), k - 1, F.lit(" sub"), k))
    c = t.customer.select(k.alias("command"), name.alias("name"))
    f = t.orders.select(F.col("o_custkey").alias("command"), F.concat(F.lit("--"), "o_orderpriority").alias("flag")).distinct().join(c,
        "command").select(F.col("name").alias("command"), "flag")
    return tools.command_help(c.select("name"), f)


@query("""WITH w AS (SELECT p_partkey AS command, '--f' || (p_partkey % 7) AS flag FROM part), f AS (SELECT p_partkey AS command,
    '--f' || (p_partkey % 5) AS flag, p_brand AS status, p_type AS type, CAST(p_size AS VARCHAR) AS "default", CASE
    WHEN p_partkey % 2 = 0 THEN 'own' END AS replacement FROM part),
  r AS (SELECT p_partkey AS command, '--f' || (p_partkey % 5) AS flag, 'edge' AS successor FROM part WHERE p_partkey % 3 = 0)
  SELECT w.command, w.flag, f.status IS NOT NULL AS known, f.status, f.type, f."default", coalesce(r.successor, f.replacement) AS replacement FROM w
    LEFT JOIN f USING (command, flag) LEFT JOIN r USING (command, flag)""")
def flag_help(t: Tables) -> DataFrame:
    flag = lambda m: F.concat(F.lit("--f"), key() % m).alias("flag")
    f = t.part.select(key().alias("command"), flag(5), F.col("p_brand").alias("status"), F.col("p_type").alias("type"),
        F.col("p_size").cast("string").alias("default"), F.when(key() % 2 == 0, "own").alias("replacement"))
    return tools.flag_help(t.part.select(key().alias("command"), flag(7)), f, t.part.filter("p_partkey % 3 = 0").select(key().alias("command"),
        flag(5), F.lit("edge").alias("successor")))


@query("""WITH tt AS (SELECT o_orderkey AS test, o_custkey AS test_class, o_custkey % 5 AS module, o_orderkey AS name, CASE o_orderstatus
    WHEN 'O' THEN 'assert' WHEN 'F' THEN 'body' ELSE 'other' END AS via, CAST(o_totalprice AS INTEGER) % 9 AS asserts FROM orders),
  c AS (SELECT c_custkey AS test_class, c_custkey % 5 AS module, c_mktsegment AS test_type FROM customer WHERE c_custkey % 2 = 0),
    x AS (SELECT DISTINCT l_partkey AS model, l_orderkey AS test FROM lineitem)
  SELECT model, test, via, asserts, test_type, place FROM (SELECT x.model, x.test, via, asserts, test_type,
    CAST(row_number() OVER (PARTITION BY x.model ORDER BY CASE via WHEN 'assert' THEN 0 WHEN 'body' THEN 1 ELSE 2 END, asserts DESC, module, name,
    test) AS INTEGER) AS place FROM x JOIN tt USING (test) LEFT JOIN c USING (test_class, module)) WHERE place <= 200""")
def tests_covering(t: Tables) -> DataFrame:
    o = t.orders
    via = F.when(F.col("o_orderstatus") == "O", "assert").when(F.col("o_orderstatus") == "F", "body").otherwise("other")
    tt = o.select(F.col("o_orderkey").alias("test"), F.col("o_custkey").alias("test_class"), (F.col("o_custkey") % 5).alias("module"),
        F.col("o_orderkey").alias("name"), via.alias("via"), (F.bround("o_totalprice").cast("int") % 9).alias("asserts"))
    c = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("test_class"), (F.col("c_custkey") % 5).alias("module"),
        F.col("c_mktsegment").alias("test_type"))
    return tools.tests_covering(t.lineitem.select(F.col("l_partkey").alias("model"), F.col("l_orderkey").alias("test")), tt, c, ["model"]).select(
        "model", "test", "via", "asserts", "test_type", "place")


@query("""WITH c AS (SELECT DISTINCT p_brand AS name, p_size % 5 AS module FROM part), m AS (SELECT p_brand AS name, p_size % 5 AS module,
    p_partkey AS method, p_size AS asserts FROM part WHERE p_partkey % 2 = 0),
  i AS (SELECT DISTINCT p_brand AS name, 'Base' || (p_size % 3) AS base FROM part UNION SELECT p_brand, 'Brand#11' FROM part WHERE p_size > 40)
  SELECT name, module, (SELECT count(DISTINCT method) FROM m WHERE m.name = c.name AND m.module = c.module) AS methods,
    CAST((SELECT coalesce(sum(asserts), 0) FROM m WHERE m.name = c.name AND m.module = c.module) AS BIGINT) AS asserts,
    coalesce((SELECT list_sort(list(DISTINCT base)) FROM i WHERE i.name = c.name), []) AS bases, (SELECT count(DISTINCT i.name) FROM i
    WHERE i.base = c.name) AS subclasses FROM c""")
def test_class_inspect(t: Tables) -> DataFrame:
    p = t.part
    c = p.select(F.col("p_brand").alias("name"), (F.col("p_size") % 5).alias("module"))
    m = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("test_class"), (F.col("p_size") % 5).alias("module"), key().alias("method"),
        F.col("p_size").alias("asserts"))
    i = p.select(F.col("p_brand").alias("name"), F.concat(F.lit("Base"), F.col("p_size") % 3).alias("base")).union(
        p.filter("p_size > 40").select("p_brand", F.lit("Brand#11")))
    return tools.test_class_inspect(c, m, i)


@query("""WITH h AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'framework' ELSE 'addon' END AS origin,
    CAST(n_regionkey AS VARCHAR) AS test_type FROM nation), i AS (SELECT a.n_name AS name, b.n_name AS base FROM nation a
    JOIN nation b ON a.n_nationkey // 2 = b.n_nationkey AND a.n_nationkey > 1 UNION SELECT n_name, 'Unknown' FROM nation)
  SELECT name, test_type, coalesce((SELECT list_sort(list(DISTINCT base)) FROM i WHERE i.name = h.name AND base IN (SELECT name FROM h)),
    []) AS parents FROM h WHERE origin = 'framework'""")
def test_base_classes(t: Tables) -> DataFrame:
    n = t.nation
    h = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "framework").otherwise("addon").alias("origin"),
        F.col("n_regionkey").cast("string").alias("test_type"))
    up = n.filter("n_nationkey > 1").select(F.col("n_name").alias("name"), F.expr("n_nationkey div 2").alias("k")).join(
        n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("base")), "k").select("name", "base")
    return tools.test_bases(h, up.union(n.select("n_name", F.lit("Unknown"))))


@query("""WITH f AS (SELECT DISTINCT l_suppkey % 7 AS module, l_partkey AS model, 'f' || l_linenumber AS name FROM lineitem),
    e AS (SELECT DISTINCT l_suppkey % 7 AS module, l_partkey AS model, 'f' || l_linenumber AS name FROM lineitem WHERE l_quantity > 10),
  r AS (SELECT f.*, e.name IS NULL AS missing FROM f LEFT JOIN e USING (module, model, name)), s AS (SELECT module, list(model || '.' || name
    ORDER BY p) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY model, name) AS p FROM r WHERE missing) WHERE p <= 200 GROUP BY 1)
  SELECT module, count(*) AS fields, count(*) FILTER (WHERE missing) AS uncovered, any_value(coalesce(shown, [])) AS shown,
    round_even(100.0::DOUBLE * count(*) FILTER (WHERE NOT missing) / count(*), 1) AS percent FROM r LEFT JOIN s USING (module) GROUP BY 1""")
def test_coverage_audit(t: Tables) -> DataFrame:
    rows = lambda d: d.select((F.col("l_suppkey") % 7).alias("module"), F.col("l_partkey").alias("model"), F.concat(F.lit("f"), "l_linenumber").alias("name"))
    return tools.coverage_audit(rows(t.lineitem), rows(t.lineitem.filter("l_quantity > 10")))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'hoot' WHEN 1 THEN 'qunit' ELSE 'tour' END AS framework FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 = 1")
def script_suites(t: Tables) -> DataFrame:
    p = F.col("page_id")
    rows = t.pages.select("page_id", F.when(p % 5 != 0, F.col("url")).alias("path"), F.when(p % 3 == 0, "hoot").when(p % 3 == 1, "qunit").otherwise(
        "tour").alias("framework"))
    return tools.script_suites(rows, "qunit").select("page_id", "framework")


@query("""WITH ev AS (SELECT event_type AS vendor, event_id % 40 AS event_id, ts AS received, user_id AS subscription,
    ts - (event_id % 5) * INTERVAL 1 DAY AS event_at, event_type AS status, event_id AS tie FROM events WHERE event_id % 11 <> 0),
  fresh AS (SELECT vendor, event_id, arg_min(subscription, (received, tie)) AS subscription FROM ev GROUP BY 1, 2)
  SELECT vendor, event_id, 'now' AS processed_at FROM fresh WHERE event_id >= 5 UNION ALL SELECT DISTINCT event_type, event_id % 5, 'then' FROM events""")
def webhook_log(t: Tables) -> DataFrame:
    return _webhooks(t)[0]


def _webhooks(t: Tables) -> tuple[DataFrame, DataFrame]:
    i = F.col("event_id")
    ev = t.events.select(F.col("event_type").alias("vendor"), (i % 40).alias("event_id"), F.col("ts").alias("received"), (i % 11 != 0).alias("valid"),
        F.col("user_id").alias("subscription"), (F.col("ts") - F.make_interval(days=(i % 5).cast("int"))).alias("event_at"),
            F.col("event_type").alias("status"))
    known = t.events.select(F.col("event_type").alias("vendor"), (i % 5).alias("event_id"), F.lit("then").alias("processed_at")).distinct()
    state = t.customer.select(F.col("c_custkey").alias("subscription"), F.lit("stored").alias("status"), F.to_timestamp(F.lit("2024-01-10")).alias("event_at"))
    return tools.webhook_batch(ev, known, state, "now")


@query()
def webhook_state(t: Tables) -> DataFrame:
    """State after the batch; a test holds it against a plain loop."""
    return _webhooks(t)[1]


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 4 <> 0 OR (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity > 20)")
def gc_unseen(t: Tables) -> DataFrame:
    n = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return store.gc_unseen(n, n.filter("l_quantity > 20"), n.filter("l_orderkey % 4 = 0"), ["l_orderkey", "l_linenumber"], ["l_orderkey"]).select(
        "l_orderkey", "l_linenumber")


_NAMES = ("_compute_x", "_inverse_x", "_search_x", "_get_default_x", "_default_x", "_get_x", "_prepare_x", "_check_x", "action_x", "write", "writes",
    "_x", "name_get", "button_x")
_KINDS = ("compute", "inverse", "search", "default", "default", "builder", "prepare", "check", "action", "crud", "public", "private", "public", "public")
_SAFETY = ("never",) * 5 + ("usually",) * 3 + ("always",) * 2 + ("usually",) * 4


@query(f"SELECT p_partkey, {list(_KINDS)}[p_partkey % 14 + 1] AS kind, {list(_SAFETY)}[p_partkey % 14 + 1] AS super_safety, p_partkey % 14 IN (8, 9) AS return_required FROM part")
def method_conventions(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (key() % 14 + 1).cast("int"))
    return t.part.select("p_partkey", scalars.method_convention(name).alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 ELSE (p_size % 2 = 0 OR p_size % 3 = 0) AND p_size % 5 <> 0 END AS readonly FROM part")
def effective_readonly(t: Tables) -> DataFrame:
    s = F.col("p_size")
    on = lambda c: F.when(c, F.lit("x"))
    return t.part.select("p_partkey", scalars.effective_readonly(F.when(key() % 3 == 0, key() % 2 == 0), on(s % 2 == 0), on(s % 3 == 0),
        on(s % 5 == 0)).alias("readonly"))


_TOKENS = (".o_form", "$a", "@media", "@brand x", ".a .b-c", ".a plain word", "&:hover", "o-flex", "button", "> .x", ".btn > .icon", "#", " .x ", "--gap")
_LITERAL = (True, True, False, False, True, False, True, True, False, False, True, False, True, False)


@query(f"SELECT p_partkey, {[int(x) for x in _LITERAL]}[p_partkey % 14 + 1] = 1 AS literal, CASE WHEN p_partkey % 14 IN (1, 2, 3) THEN 'content' ELSE 'entity_name' END AS searched FROM part")
def style_literals(t: Tables) -> DataFrame:
    q = F.element_at(F.array(*[F.lit(n) for n in _TOKENS]), (key() % 14 + 1).cast("int"))
    return t.part.select("p_partkey", text.style_literal(q).alias("literal"), text.literal_column(q).alias("searched"))


_LINES = ("cr.commit()", "cr.commit()  # noqa", "cr.commit() # noqa: E1, W2", "the translation method", "translation", "x # NOQA cr.commit()")


@query("""WITH l AS (SELECT 'p' || (p_partkey // 6) AS path, CAST(p_partkey % 6 AS INTEGER) + 1 AS line, p_partkey % 6 AS k FROM part)
  SELECT path, line, 'E1' AS rule_id, 'pattern' AS match FROM l WHERE k IN (0, 5) UNION ALL SELECT path, line, 'W1', 'fuzzy' FROM l WHERE k = 3
  UNION ALL SELECT path, line, 'W2', 'fuzzy' FROM l WHERE k = 3""")
def lint_check(t: Tables) -> DataFrame:
    lines = t.part.select(F.concat(F.lit("p"), F.expr("p_partkey div 6")).alias("path"), ((key() % 6).cast("int") + 1).alias("line"),
        F.element_at(F.array(*[F.lit(x) for x in _LINES]), (key() % 6 + 1).cast("int")).alias("text"))
    rules = t.spark.createDataFrame([("E1", r"cr\.commit\(\)", "commit"), ("W1", "(unclosed", "avoid the translation method"),
        ("W2", None, "translation method string"), ("W3", None, "translation")], "rule_id string, code_pattern string, message string")
    return spec.check_lines(lines, rules)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'vendor' WHEN c_custkey % 5 = 0 THEN 'enterprise' WHEN c_custkey % 5 = 1
    AND c_nationkey % 2 = 0 THEN 'vendor' WHEN c_custkey % 5 = 2 THEN 'association' WHEN c_custkey % 5 = 3 AND c_nationkey % 3 = 0 THEN 'community'
    ELSE 'custom' END AS edition FROM customer""")
def editions(t: Tables) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    licence = F.when(k % 5 == 0, "oeel-1").when(k % 5 == 1, "OPL-1").when(k % 5 == 2, "Assoc-2").when(k % 5 == 3, "LGPL-3")
    e = repos.edition(F.when(k % 6 == 0, "vx_a").otherwise("a"), licence, F.when(n % 2 == 0, "Vendor Ltd"),
        F.when(n % 3 == 0, "/s/addons/a").otherwise("/s/a"), prefixes=["vx_"], authors=["Vendor"], association="assoc")
    return t.customer.select("c_custkey", e.alias("edition"))


@query("""SELECT c_custkey, list_contains(t, 'BUILDING') OR list_contains(t, 'x1') AS hit, list_filter(t, lambda x: x IN ('BUILDING',
    'x1'))[1] AS first FROM (SELECT c_custkey, [c_mktsegment, 'x' || (c_custkey % 3)] AS t FROM customer)""")
def array_match(t: Tables) -> DataFrame:
    tags = F.array("c_mktsegment", F.concat(F.lit("x"), F.col("c_custkey") % 3))
    return t.customer.select("c_custkey", scalars.any_of(tags, ["BUILDING", "x1"]).alias("hit"), scalars.first_of(tags, ["BUILDING", "x1"]).alias("first"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN true ELSE (p_size % 20) >= 5 AND (p_size % 20) <= 15 END AS inside,
    p_size % 4 <> 0 AS shaped FROM part""")
def version_range(t: Tables) -> DataFrame:
    s = F.col("p_size")
    v = F.when(s % 7 == 0, "main").otherwise((s % 20).cast("string"))
    shape = F.when(s % 4 == 0, F.concat(s, F.lit(".0x"))).otherwise(F.concat(s, F.lit(".0")))
    return t.part.select("p_partkey", scalars.in_version_range(v, F.lit("5"), F.lit("15")).alias("inside"), scalars.is_version(shape).alias("shaped"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS found FROM customer
    WHERE c_mktsegment ILIKE '%auto%' OR c_mktsegment ILIKE '%build%'""")
def existence_probe(t: Tables) -> DataFrame:
    c = t.customer.filter(scalars.contains_ci(F.col("c_mktsegment"), F.lit("AUTO")) | scalars.contains_ci(F.col("c_mktsegment"), F.lit("Build")))
    return joins.exists_in(c.filter(scalars.optional_equal(F.col("c_nationkey"), None)).select("c_custkey"),
        t.orders.filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "found")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '[m] ' || p_brand || '.' || p_name || ' (v)' || chr(10) || p_type
    WHEN 1 THEN '[m] ' || p_brand || ': ' || p_name || ' (d)' || chr(10) || p_type WHEN 2 THEN '[m] ' || p_name || ' (d)' || chr(10) || p_type
    WHEN 3 THEN '[m] ' || p_name || chr(10) || p_type ELSE p_type END AS content FROM part""")
def chunk_texts(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("method", "field", "view", "qweb", "css")]), (key() % 5 + 1).cast("int"))
    head = text.chunk_header(kind, F.lit("m"), F.lit("v"), F.col("p_brand"), F.col("p_name"), F.lit("d"))
    return t.part.select("p_partkey", text.headed(kind, head, F.col("p_type")).alias("content"))


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%T%' AND (p_size % 3 = 0 OR p_size % 3 = 1)")
def view_type_alias(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "tree").when(F.col("p_size") % 3 == 1, "list").otherwise("form")
    return t.part.filter("p_type like '%T%'").filter(tools.view_type(kind, "list")).select("p_partkey")


@query("""WITH x AS (SELECT p_partkey, p_size, p_name, p_brand, list_transform(range(p_size % 14), lambda i: 't' || i) AS names FROM part)
  SELECT p_partkey, '[js:hoot] ' || p_brand || ' (v)' || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'describe: ' || p_name || ', b' ELSE '' END || CASE WHEN len(names) > 0 THEN chr(10) || 'tests: ' || array_to_string(names[1:10], ', ') ELSE '' END
      || CASE WHEN len(names) > 10 THEN chr(10) || '(+ ' || (len(names) - 10) || ' more tests)' ELSE '' END || CASE WHEN len(names) > 0 THEN chr(10) || 'mock_models: ' || array_to_string(names[1:5], ', ') ELSE '' END AS suite,
    p_name || CASE WHEN len(names) > 0 THEN chr(10) || '---' || chr(10) || array_to_string(names, chr(10)) ELSE '' END AS pattern, 'python__' || p_brand AS entity,
    CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'mixin:' || p_name ELSE 'variable:' || p_name END AS style FROM x""")
def chunk_bodies(t: Tables) -> DataFrame:
    """Chunks of script suites and curated patterns, and the names of style chunks."""
    names = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(F.lit("t"), i))
    names = F.slice(names, F.lit(1), F.col("p_size") % 14)
    none = F.array().cast("array<string>")
    describes = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_name"), F.lit("b"))).otherwise(none)
    kind = F.when(key() % 3 == 1, "mixin").when(key() % 3 == 2, "variable").otherwise("selector")
    language = F.when(key() % 3 == 1, "scss").when(key() % 3 == 2, "less").otherwise("css")
    return t.part.select("p_partkey", text.suite_text(F.lit("hoot"), F.col("p_brand"), F.lit("v"), describes, names, none, none, names).alias("suite"), text.pattern_text(F.col("p_name"), names).alias("pattern"),
        text.pattern_entity(F.lit("python"), F.col("p_brand")).alias("entity"), text.style_entity(language, kind, F.col("p_name")).alias("style"))
