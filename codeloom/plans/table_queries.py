"""Aggregates, paging, set operations and control-plane operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, control, diff, joins, ranking
from ..operators.lineage import sized
from .registry import Tables, query


@query("SELECT coalesce(CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_mktsegment END, '(uncategorized)') AS category, count(*) AS n FROM customer GROUP BY 1")
def category_counts(t: Tables):
    return aggregates.category_counts(t.customer.withColumn("cat", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment"))), "cat")


@query("SELECT c_mktsegment AS category, count(*) FILTER (WHERE c_nationkey < 10) AS here, count(*) AS total, greatest(count(*) - count(*) FILTER (WHERE c_nationkey < 10), 0) AS elsewhere FROM customer GROUP BY 1")
def coverage_diff(t: Tables):
    return aggregates.coverage_diff(t.customer, "c_mktsegment", F.col("c_nationkey") < 10)


@query("""WITH h AS (SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_nationkey < 2 GROUP BY 1),
    a AS (SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1)
  SELECT category, coalesce(h.n, 0) AS here, coalesce(a.n, 0) AS total, greatest(coalesce(a.n, 0) - coalesce(h.n, 0), 0) AS elsewhere FROM a FULL
    JOIN h USING (category)""")
def coverage_outer(t: Tables):
    here = t.customer.filter("c_nationkey < 2")
    return aggregates.outer_coverage(aggregates.category_counts(here, "c_mktsegment"), aggregates.category_counts(t.customer, "c_mktsegment"))


@query("SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS modules FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2")
def having_overrides(t: Tables):
    return aggregates.overridden(t.lineitem, ["l_partkey", "l_linenumber"], "l_suppkey")


@query("""WITH z AS (SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49))
  SELECT p_partkey, p_name, (SELECT count(*) FROM z) AS total FROM z ORDER BY p_partkey LIMIT 200""")
def zero_coverage(t: Tables):
    """The reference lists 200 such fields at most, in name order, and says how many there are."""
    covered = t.lineitem.filter("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey")
    return ranking.with_total(aggregates.zero_coverage(t.part, covered, "p_partkey").select("p_partkey", "p_name"), [F.col("p_partkey")], 0, 200)


@query("""WITH m AS (SELECT l_partkey AS model, l_suppkey AS module, l_returnflag AS version, bool_or(l_linenumber = 2 AND l_returnflag <> 'N') AS is_definition FROM lineitem GROUP BY 1, 2, 3),
  d AS (SELECT dst AS module, version, count(DISTINCT src) AS n FROM (SELECT s_suppkey AS src, s_suppkey // 3 AS dst, v AS version FROM supplier, (SELECT unnest(['A', 'N']) AS v)) GROUP BY ALL),
  k AS (SELECT m.*, coalesce(n, 0) AS dependents, bool_or(is_definition) OVER (PARTITION BY version) AS any_ FROM m LEFT JOIN d USING (module, version)),
  p AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY dependents DESC, model, module) - 1 AS place FROM k WHERE is_definition OR NOT any_)
  SELECT version, CAST(place AS INTEGER) AS place, model, module, dependents FROM p WHERE place < 100""")
def top_models(t: Tables):
    """The hundred models of each version that most depend on; a version without definitions lists all its models."""
    li = t.lineitem
    n = li.count()
    li = sized(li.select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber"), n, "l_suppkey", "l_returnflag")
    m = li.groupBy(F.col("l_partkey").alias("model"), F.col("l_suppkey").alias("module"), F.col("l_returnflag").alias("version")).agg(F.bool_or((F.col("l_linenumber") == 2) & (F.col("l_returnflag") != "N")).alias("is_definition"))
    d = t.supplier.select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 3").alias("dst"), F.explode(F.array(F.lit("A"), F.lit("N"))).alias("version"))
    return aggregates.top_models(m, d, rows=n)


@query("""WITH v AS (SELECT o_custkey AS k, count(*) AS views FROM orders GROUP BY 1), m AS (SELECT o_custkey AS k, count(*) AS methods FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY 1), j AS (SELECT o_custkey AS k, count(*) AS js FROM orders
    WHERE o_orderpriority LIKE '1%' GROUP BY 1),
  s AS (SELECT c_custkey, coalesce(views, 0) AS views, coalesce(methods, 0) AS methods, coalesce(js, 0) AS js FROM customer LEFT
    JOIN v ON v.k = c_custkey LEFT JOIN m ON m.k = c_custkey LEFT JOIN j ON j.k = c_custkey)
  SELECT *, views + methods + js AS score, CASE WHEN views + methods + js >= 10 THEN 'HIGH' WHEN views + methods + js >= 4 THEN 'MEDIUM'
    ELSE 'LOW' END AS severity FROM s""")
def impact_risk(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    m = o.join(t.lineitem.filter("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey"))
    return aggregates.impact(t.customer, "c_custkey", ("views", o), ("methods", m), ("js", o.filter(F.col("o_orderpriority").startswith("1"))))


@query("SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS n_super, count(*) AS n, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS ratio FROM lineitem GROUP BY 1")
def super_ratio(t: Tables):
    return aggregates.super_ratio(t.lineitem, ["l_suppkey"], F.col("l_returnflag") == "R").withColumn("ratio", F.round("ratio", 6))


@query("""WITH u AS (SELECT user_id, count(*) AS used FROM events GROUP BY 1), p AS (SELECT c_custkey AS user_id, c_custkey % 13 * 10 AS quota FROM customer)
  SELECT user_id, quota, coalesce(used, 0) AS used, greatest(quota - coalesce(used, 0), 0) AS remaining, CASE
    WHEN quota > 0 THEN round_even(100.0::DOUBLE * coalesce(used, 0) / quota, 1) END AS percent FROM p LEFT JOIN u USING (user_id)""")
def quota_usage(t: Tables):
    plans = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 13 * 10).alias("quota"))
    return aggregates.quota(t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("used")), plans, "user_id")


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_custkey % 7 = 0) AS legacy FROM orders GROUP BY 1")
def legacy_count(t: Tables):
    return aggregates.legacy_count(t.orders.withColumn("prop", F.when(F.col("o_custkey") % 7 != 0, F.lit(1))), ["o_orderpriority"], "prop")


@query("""SELECT l_suppkey, list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))) AS tags, bool_or(l_quantity > 49) AS flag,
    arg_min(l_partkey, l_orderkey * 100 + l_linenumber) FILTER (WHERE l_partkey % 3 = 0) AS first_part FROM lineitem GROUP BY 1""")
def merged_properties(t: Tables):
    d = t.lineitem.select("l_suppkey", F.array("l_returnflag", "l_linestatus").alias("tags"), (F.col("l_quantity") > 49).alias("flag"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("first_part"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return aggregates.merged_properties(d, ["l_suppkey"], "tags", "flag", "first_part", "at")


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def views_per_type(t: Tables):
    return t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def active_keys(t: Tables):
    return t.orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("active"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS dependents FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def top_dependents(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("dependents")).orderBy(F.desc("dependents"), "l_partkey").limit(100)


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def page_with_total(t: Tables):
    return ranking.with_total(t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name"),
        [F.col("c_name").asc_nulls_last(), F.col("c_custkey").asc()], 40, 20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21")
def overflow_probe(t: Tables):
    return ranking.probe(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


@query("""WITH v AS (SELECT DISTINCT CASE WHEN p_partkey % 50 = 0 THEN 'main' || (p_size % 3) ELSE (p_size % 15) || '.' || (p_partkey % 7) END AS version FROM part)
  SELECT version, row_number() OVER (ORDER BY TRY_CAST(split_part(version, '.', 1) AS INT) DESC NULLS LAST, TRY_CAST(split_part(version, '.', 2) AS INT) DESC NULLS LAST, version) - 1 AS place FROM v""")
def version_order(t: Tables):
    """All versions, newest first; names of another shape come last."""
    version = F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("main"), F.col("p_size") % 3)).otherwise(F.concat_ws(".", (F.col("p_size") % 15).cast("string"), (F.col("p_partkey") % 7).cast("string")))
    return ranking.newest_versions(t.part.select(version.alias("version")).distinct()).select("version", "place")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS period FROM orders ORDER BY 1 DESC LIMIT 6")
def latest_periods(t: Tables):
    return t.orders.select(F.date_format("o_orderdate", "yyyyMM").alias("period")).distinct().orderBy(F.desc("period")).limit(6)


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, kind, asserts FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1
    ELSE 2 END AS kind, CAST(l_quantity AS INTEGER) AS asserts FROM lineitem) ORDER BY kind, asserts DESC, l_suppkey, l_orderkey, l_linenumber LIMIT 200""")
def test_ranking(t: Tables):
    """The listing shows 200 tests at most: those that assert come first."""
    kind = F.when(F.col("l_returnflag") == "A", "assert").when(F.col("l_returnflag") == "R", "body").otherwise("other")
    d = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", kind.alias("via"), F.col("l_quantity").cast("int").alias("asserts"))
    ranked = ranking.tests_first(d, "via", "asserts", ["l_suppkey", "l_orderkey", "l_linenumber"], 200)
    return ranked.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", ranking.via_rank(F.col("via")).alias("kind"), "asserts")


@query("""SELECT o_custkey AS id, 'order' AS leg, o_orderpriority AS what FROM orders WHERE o_orderstatus = 'F' UNION SELECT user_id, 'event',
    event_type FROM events WHERE value > 50""")
def deprecated_union(t: Tables):
    a = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit("order").alias("leg"), F.col("o_orderpriority").alias("what"))
    b = t.events.filter("value > 50").select(F.col("user_id").alias("id"), F.lit("event").alias("leg"), F.col("event_type").alias("what"))
    return diff.union_distinct(a, b)


_SYMBOLS = "SELECT p_partkey AS name, CASE WHEN p_size % {m} = 0 THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 1 END AS replaced_by FROM part WHERE p_partkey % {g} <> 0"


@query(f"""WITH o AS ({_SYMBOLS.format(m=4, g=3)}), n AS ({_SYMBOLS.format(m=6, g=4)})
  SELECT name, bucket, CASE WHEN bucket = 'replaced' THEN r END AS successor FROM (SELECT coalesce(o.name, n.name) AS name, o.replaced_by AS r, CASE
    WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL AND o.replaced_by IN (SELECT name FROM n) THEN 'replaced' WHEN n.name IS NULL THEN 'removed'
    WHEN n.status = 'deprecated' AND o.status <> 'deprecated' THEN 'deprecated' ELSE 'stable' END AS bucket FROM o FULL JOIN n ON o.name = n.name)""")
def version_diff(t: Tables):
    side = lambda m, g: t.part.filter(f"p_partkey % {g} <> 0").select(F.col("p_partkey").alias("name"),
        F.when(F.col("p_size") % m == 0, "deprecated").otherwise("active").alias("status"),
            F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") + 1).alias("replaced_by"))
    return diff.version_diff(side(4, 3), side(6, 4))


@query("""WITH o AS (SELECT p_partkey AS flag, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS flag, CASE
    WHEN p_partkey % 7 = 0 THEN p_type ELSE p_brand END AS v FROM part WHERE p_partkey % 4 <> 0)
  SELECT * FROM (SELECT coalesce(o.flag, n.flag) AS flag, CASE WHEN o.flag IS NULL THEN 'added' WHEN n.flag IS NULL THEN 'removed'
    WHEN o.v IS DISTINCT FROM n.v THEN 'changed' END AS change, o.v AS old_value, n.v AS new_value FROM o FULL JOIN n ON o.flag = n.flag)
    WHERE change IS NOT NULL""")
def cli_flag_diff(t: Tables):
    k = F.col("p_partkey")
    old = t.part.filter("p_partkey % 3 <> 0").select(k.alias("flag"), F.col("p_brand").alias("v"))
    new = t.part.filter("p_partkey % 4 <> 0").select(k.alias("flag"), F.when(k % 7 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("v"))
    return diff.flag_diff(old, new, ["flag"], "v")


@query("""WITH a AS (SELECT c_custkey, string_split(c_name, '#') AS o, [c_mktsegment, 'Customer'] AS n FROM customer)
  SELECT c_custkey, list_sort(list_filter(o, lambda x: NOT list_contains(n, x))) AS lost, list_sort(list_filter(n, lambda x: NOT list_contains(o,
    x))) AS gained, list_sort(list_filter(o, lambda x: list_contains(n, x))) AS kept FROM a""")
def decorator_diff(t: Tables):
    a = t.customer.select("c_custkey", F.split("c_name", "#").alias("o"), F.array("c_mktsegment", F.lit("Customer")).alias("n"))
    return diff.array_diff(a, "o", "n").select("c_custkey", "lost", "gained", "kept")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def optional_match(t: Tables):
    return t.customer.join(t.nation.filter("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 48)")
def uncovered_modules(t: Tables):
    return joins.uncovered(t.supplier.select("s_suppkey"), t.lineitem.filter("l_discount > 0.09 and l_quantity > 48").withColumnRenamed("l_suppkey",
        "s_suppkey"), "s_suppkey")


@query("""SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' END AS found_in
    FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.k = c_custkey LEFT
    JOIN (SELECT user_id AS k, max(event_id) AS v FROM events GROUP BY 1) b ON b.k = c_custkey""")
def prefer_first(t: Tables):
    a = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("v"))
    b = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_id").alias("v"))
    return joins.prefer(t.customer.select("c_custkey"), a, b, "c_custkey", "v")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def correlated_count(t: Tables):
    return joins.counted(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#99')")
def literal_list_join(t: Tables):
    return joins.in_list(t.part.select("p_partkey", "p_brand"), "p_brand", ["Brand#11", "Brand#23", "Brand#99"])


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members, (SELECT count(*) FROM supplier
    WHERE s_nationkey = n_nationkey) AS repos, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS profiles FROM nation""")
def tenants_with_counts(t: Tables):
    c, s = t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.supplier.withColumnRenamed("s_nationkey", "n_nationkey")
    return control.tenants_with_counts(t.nation.select("n_nationkey"), "n_nationkey", ("members", c), ("repos", s), ("profiles", c.filter("c_acctbal < 0")))


@query("""SELECT c_custkey AS tenant, c_mktsegment AS key, coalesce(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'own' || c_custkey END,
    CASE WHEN c_mktsegment < 'F' THEN 'system' || c_mktsegment END, 'default') AS value FROM customer""")
def setting_resolution(t: Tables):
    w = t.customer.select(F.col("c_custkey").alias("tenant"), F.col("c_mktsegment").alias("key"))
    own = w.filter("tenant % 3 = 0").withColumn("value", F.when(F.col("tenant") % 2 == 0, F.concat(F.lit("own"), "tenant")))
    seg = w.select("key").distinct()
    system = seg.filter("key < 'F'").select(F.lit(None).cast("bigint").alias("tenant"), "key", F.concat(F.lit("system"), "key").alias("value"))
    return control.resolve_setting(w, own.unionByName(system), seg.withColumn("value", F.lit("default")))


@query("SELECT c_custkey, CAST(coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 END, c_nationkey * 100) AS BIGINT) AS quota FROM customer")
def plan_override(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", control.effective_limit(F.when(k % 4 == 0, k % 3), F.col("c_nationkey").cast("bigint") * 100).alias("quota"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY 1")
def latest_job(t: Tables):
    return control.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey",
        "o_orderkey")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, upper(n_name) || '?' FROM nation
    WHERE n_nationkey % 2 <> 0""")
def insert_absent(t: Tables):
    n = t.nation.select("n_nationkey", "n_name")
    return control.insert_absent(n.filter("n_nationkey % 2 = 0"), n.withColumn("n_name", F.concat(F.upper("n_name"), F.lit("?"))), ["n_nationkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'old' WHEN c_custkey % 2 = 0 THEN 'new' END AS claimant FROM customer")
def first_claim(t: Tables):
    k = F.col("c_custkey")
    return control.first_claim(t.customer.select("c_custkey", F.when(k % 3 == 0, "old").alias("claimant")),
        t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("claimant")), "c_custkey", "claimant")


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey // 2 > 0 AND s_suppkey > 1 THEN s_suppkey // 2 END AS parent_id FROM supplier")
def seed_parents(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    up = s.select(F.col("id").alias("pid"), F.col("name").alias("parent_name"))
    rows = s.withColumn("pid", F.expr("case when id div 2 > 0 then id div 2 end")).join(up, "pid", "left").select("id", "name", "parent_name")
    return control.seed_parents(rows)


@query("""WITH x AS (SELECT l_partkey, l_suppkey % 3 AS module, l_orderkey * 10 + l_linenumber AS arrival, l_quantity > 40 AS long_format FROM lineitem)
  SELECT l_partkey, module, coalesce(max(arrival) FILTER (WHERE long_format), min(arrival)) AS arrival FROM x GROUP BY 1, 2""")
def registry_pick(t: Tables):
    x = t.lineitem.select("l_partkey", (F.col("l_suppkey") % 3).alias("module"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
        (F.col("l_quantity") > 40).alias("long_format"))
    return control.registry_pick(x, ["l_partkey", "module"]).select("l_partkey", "module", "arrival")


@query("""SELECT event_id AS id, event_type AS action FROM events WHERE event_type ILIKE '%i%' AND CAST(user_id AS VARCHAR) ILIKE '1%'
    ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10""")
def audit_page(t: Tables):
    e = t.events.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"))
    return control.search_audit(e, "I", "1", 10, 50).select("id", "action")
