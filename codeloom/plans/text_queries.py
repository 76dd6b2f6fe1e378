"""Search, text and event operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import joins, search
from ..streaming import events
from .registry import Tables, query

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_COS = f"{_DOT} / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


def _query_vector(t: Tables) -> list[float]:
    return t.embeddings.orderBy("vec_id").limit(1).first()["embedding"]


@query(f"WITH b AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(cos, 6) AS cosine FROM (SELECT vec_id, {_COS} AS cos FROM embeddings a, b WHERE label < 5) ORDER BY cos DESC, vec_id LIMIT 20")
def cosine_topk(t: Tables):
    hits = search.top_k(t.embeddings.filter("label < 5"), _query_vector(t), 20, key="vec_id")
    return hits.select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH b AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id, label AS module, {_COS} AS cos
    FROM embeddings a, b), d AS (SELECT label AS module, count(*) AS dependents FROM embeddings GROUP BY 1)
  SELECT vec_id, module, round(cos * (1 + 0.02 * ln(coalesce(dependents, 0) + 1.0)) + CASE WHEN module % 4 = 0 THEN 0.2 ELSE 0.0 END, 6) AS score
    FROM h LEFT JOIN d USING (module)""")
def centrality_rerank(t: Tables):
    q = F.array(*[F.lit(float(x)) for x in _query_vector(t)])
    e = t.embeddings.withColumnRenamed("label", "module")
    hits = e.select("vec_id", "module", scalars.cosine(F.col("embedding"), q).alias("cosine"))
    ranked = search.rerank(hits, e.groupBy("module").agg(F.count(F.lit(1)).alias("dependents")), e.filter("module % 4 = 0").select("module"))
    return ranked.select("vec_id", "module", F.round("score", 6).alias("score"))


@query(f"WITH b AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id, label, {_COS} AS cos FROM embeddings a, b ORDER BY cos DESC, vec_id LIMIT 20) SELECT vec_id FROM h WHERE label % 2 = 0 ORDER BY cos DESC, vec_id LIMIT 5")
def pattern_search(t: Tables):
    return search.pattern_search(t.embeddings, _query_vector(t), 5, F.col("label") % 2 == 0, None, key="vec_id").select("vec_id")


@query(f"WITH b AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id, label, {_COS} AS cos FROM embeddings a, b ORDER BY cos DESC, vec_id LIMIT 20) SELECT vec_id, label, (SELECT count(*) FROM embeddings e WHERE e.label = h.label) AS dependents FROM h WHERE label % 2 = 0 ORDER BY cos DESC, vec_id LIMIT 5")
def one_pattern_lookup(t: Tables):
    """A single request's form: five nearest of a kind with what depends on their modules."""
    hits = search.pattern_search(t.embeddings, _query_vector(t), 5, F.col("label") % 2 == 0, None, key="vec_id").select("vec_id", "label")
    return joins.counted(hits, t.embeddings.select("label"), "label", "dependents")


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_space(t: Tables):
    return search.one_space(t.embeddings)


@query(r"SELECT doc_id, length(text) AS n FROM documents WHERE text ILIKE '%100\%%' ESCAPE '\' OR text ILIKE '%\_the%' ESCAPE '\' OR text ILIKE '%. the th%' ESCAPE '\'")
def like_escape(t: Tables):
    hit = scalars.ilike_literal(F.col("text"), "100%") | scalars.ilike_literal(F.col("text"), "_the") | scalars.ilike_literal(F.col("text"), ". THE th")
    return t.documents.filter(hit).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query(r'''SELECT page_id, length(html) AS n FROM pages WHERE html ILIKE '%class="ad"%' ESCAPE '\' ORDER BY length(html), url, page_id LIMIT 30''')
def literal_lookup(t: Tables):
    found = search.literal_lookup(t.pages, 'CLASS="ad"', 30, "html", [F.col("url"), F.col("page_id")])
    return found.select("page_id", F.length("html").cast("bigint").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red%' OR p_name ILIKE '%part 1%' OR p_name ILIKE '%#7%' ORDER BY length(p_name), p_name, p_partkey LIMIT 40")
def lexical_search(t: Tables):
    found = search.lexical(t.part, ["red", "part 1", "#7"], 40, "p_name", [F.col("p_name"), F.col("p_partkey")])
    return found.select("p_partkey", "p_name")


@query("""WITH l AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings WHERE label = 1), s AS (SELECT vec_id,
    label / 10.0 AS score FROM embeddings WHERE vec_id % 2 = 0),
  u AS (SELECT vec_id, 2.0 + ((SELECT count(*) FROM l) - place) * 1e-6 AS score, 'literal' AS match FROM l UNION ALL SELECT vec_id, score, 'semantic' FROM s)
  SELECT vec_id, round(score, 7) AS score, match FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) AS rn FROM u)
    WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 60""")
def literal_first_merge(t: Tables):
    from pyspark.sql import Window

    lit = t.embeddings.filter("label = 1").select("vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("place"))
    sem = t.embeddings.filter("vec_id % 2 = 0").select("vec_id", (F.col("label") / 10.0).alias("score"))
    return search.merge_literal_first(lit, sem, ["vec_id"], 60).withColumn("score", F.round("score", 7))


@query("""SELECT doc_id, CAST(k AS INTEGER) AS chunk_idx, substring(text, k * 1792 + 1, 2048) AS content FROM (SELECT doc_id, text, unnest(range(0,
    CASE WHEN length(text) > 2048 THEN CAST(ceil((length(text) - 2048) / 1792) AS BIGINT) ELSE 0 END + 1)) AS k FROM documents WHERE length(text) > 0)""")
def chunk_windows(t: Tables):
    return text.chunks(t.documents.select("doc_id", "text"))


@query("""SELECT doc_id, CAST(coalesce(ceil(length(text) / 3.0), 0) AS INTEGER) AS tokens, CAST(CASE WHEN length(text) <= 300 THEN 1
    ELSE ceil(length(text) / 300.0) END AS INTEGER) AS pieces FROM documents""")
def token_budget(t: Tables):
    x = F.col("text")
    return t.documents.select("doc_id", scalars.token_estimate(x).alias("tokens"), F.size(text.budget_pieces(x, 100)).alias("pieces"))


_STOP = "a an the and or of to in for on with is are was be by at as it its from how can do use get set has".split()


@query("""SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN\\pM_.]+'),
    lambda w: trim(w, '.')), lambda w: length(w) >= 3 AND w NOT IN ({})))) AS words FROM documents""".format(", ".join(f"'{w}'" for w in _STOP)))
def keywords(t: Tables):
    """Sorted for comparison."""
    return t.documents.select("doc_id", F.sort_array(text.keywords(F.coalesce("text", F.lit("")))).alias("words"))


@query("SELECT CASE WHEN contains(p_name, '.') THEN p_name ELSE p_brand || '.' || p_name END AS xmlid, p_partkey FROM part")
def xmlid(t: Tables):
    return t.part.select(scalars.qualify_xmlid(F.col("p_name"), F.col("p_brand")).alias("xmlid"), "p_partkey")


@query("SELECT vec_id, round(embedding[1] / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first, len(embedding) AS dim FROM embeddings")
def l2_normalise(t: Tables):
    v = scalars.l2_normalise(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(v[0], 6).alias("first"), F.size("embedding").cast("bigint").alias("dim"))


@query("""SELECT user_id, strftime(ts, '%Y%m') AS period, count(*) AS used FROM events GROUP BY 1, 2""")
def usage_by_month(t: Tables):
    return events.usage_by_month(t.events, "user_id", "ts")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def props_json(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_LATE = "SELECT user_id, event_id, ts - (event_id % 5) * INTERVAL 1 DAY AS event_at, event_type AS status, CASE WHEN event_id % 4 = 0 THEN event_type END AS seats FROM events"


@query(f"""WITH e AS (SELECT *, max(event_at) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM ({_LATE}))
  SELECT user_id, arg_max(status, event_id) FILTER (WHERE top IS NULL OR event_at >= top) AS status, arg_max(seats, event_id)
    FILTER (WHERE seats IS NOT NULL) AS seats, max(event_at) AS event_at FROM e GROUP BY 1""")
def late_event_guard(t: Tables):
    shift = F.make_interval(days=(F.col("event_id") % 5).cast("int"))
    e = t.events.select("user_id", "event_id", (F.col("ts") - shift).alias("event_at"), F.col("event_type").alias("status"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("seats"))
    return events.late_guard(e, "user_id", "event_at", "event_id", ["status"], ["seats"])


@query("""WITH e AS (SELECT event_id, user_id, ts, value > 10 AS failed FROM events)
  SELECT event_id, n AS failures, n >= 5 AS locked FROM (SELECT event_id, CAST(coalesce(sum(CAST(failed AS INTEGER)) OVER (PARTITION BY user_id
    ORDER BY epoch_us(ts) RANGE BETWEEN 900000000 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM e)""")
def failure_throttle(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", (F.col("value") > 10).alias("failed"))
    return events.failure_throttle(e, "user_id", "ts", "failed").select("event_id", "failures", "locked")


@query()
def sliding_limit(t: Tables):
    """Sequential admission; tests hold it against a plain loop."""
    return events.sliding_limit(t.events, "user_id", "ts", "event_id", 3, 3 * 3600)


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def event_intake(t: Tables):
    e = t.events.select("event_type", "user_id", "event_id", "value")
    return events.intake(e, ["event_type", "user_id"], "event_id").select("event_type", "user_id", "event_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t: Tables):
    return events.tumbling(t.events, "ts", "1 day", "value", "event_type").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts,
    event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new, event_id FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e) SELECT user_id, min(ts) AS session_start,
    count(*) AS n FROM s GROUP BY user_id, sid""")
def session(t: Tables):
    return events.sessions(t.events, "user_id", "ts", "6 hours")
