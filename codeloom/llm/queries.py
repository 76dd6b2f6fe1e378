"""The operators bound to the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html, media, mixing, packing, quantize, sharding, simhash, substring, token_store, toxicity, urls

#: The id that ends a document in the contracts.
END_ID = 2


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"), tokenizer(), END_ID)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 40)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(table(spark, sf_dir, "documents")))


def op6_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), urls.host_of(F.col("url")))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=END_ID)


def op9_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compress(table(spark, sf_dir, "embeddings"))


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_decontamination": op2_decontamination,
    "op3_jump_sharding": op3_jump_sharding,
    "op4_simhash": op4_simhash,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_png_media": op6_png_media,
    "op7_main_text": op7_main_text,
    "op8_best_fit": op8_best_fit,
    "op9_url_vocabulary": op9_url_vocabulary,
    "op10_toxicity": op10_toxicity,
    "op11_heap_lloyd": op11_heap_lloyd,
    "op12_curriculum": op12_curriculum,
    "op13_divergence": op13_divergence,
}


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _op9_sql() -> str:
    hits = "CAST(list_sum([CAST(regexp_matches(u, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)') AS INTEGER) for w in [{}]]) AS INTEGER)"
    fits = "\n".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(urls.RULES, key=lambda r: (-len(r[1]), r[0] != "block")))
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in urls.RULES)
    return f"""
    WITH p AS (
      SELECT page_id, coalesce(translate(url, '{urls.UPPER}', '{urls.LOWER}'), '') AS u,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    h AS (SELECT page_id, host, path, {hits.format(_words(urls.STRICT))} AS strict_hits, {hits.format(_words(urls.SOFT))} AS soft_hits,
        CASE {fits} END AS rule FROM p)
    SELECT page_id, host, path, rule,
      CASE rule {verdicts} ELSE CASE WHEN strict_hits >= 1 OR soft_hits >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END END AS verdict,
      strict_hits, soft_hits FROM h"""


def _op2_sql() -> str:
    """The same rules with windows as strings instead of hashes. Patterns that look around a match take two passes here."""
    d = decontaminate
    once = lambda t, r, to: f"regexp_replace({t}, '{r}', '{to}', 'g')"
    twice = lambda t, r, to: once(once(t, r, to), r, to)
    plain = f"translate(coalesce(text, ''), '{d.COMMA}{d.POINT}{d.SIGN}{d.START}', '    ')"
    numbers = _words(tuple(d.NUMBER_WORDS))
    before = r"([\p{L}§,;:][ \t\n\r])"
    name = r"\p{Lu}\p{Ll}+"
    unit = rf"([0-9]) ?((?i:{d.UNITS}))([^\p{{L}}\p{{N}}]|$)"
    template = once(once(twice(plain, rf"{before}{name}(?:[ \t]{name})*", r"\1§"), unit, r"\1 ¤\3"), "[0-9]+(?:[.,][0-9]+)*(?:[eE][-+−]?[0-9]+)?", "0")
    slots = twice(twice(plain, f"{before}({name})", r"\1§\2"), rf"(§{name})[ \t](§\p{{Lu}})", r"\1\2")
    slots = twice(once(slots, unit, r"\1 ¤\2\3"), rf"(^|[^\p{{L}}\p{{N}}§¤{d.START}])({name})", rf"\1{d.START}\2")
    slots = once(slots, r"(^|[^\p{L}\p{N}§¤])[-−]([0-9])", rf"\1{d.SIGN}\2")
    slots = once(once(slots, r"([0-9][eE])[-−]([0-9])", rf"\1{d.SIGN}\2"), r"([0-9][eE])\+([0-9])", r"\1\2")
    slots = twice(twice(slots, "([0-9]),([0-9])", rf"\1{d.COMMA}\2"), r"([0-9])\.([0-9])", rf"\1{d.POINT}\2")
    tokens = lambda t: f"list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}§¤{d.COMMA}{d.POINT}{d.SIGN}{d.START}]+'), lambda x: x <> '')"
    words = lambda t: f"list_transform({tokens(t)}, lambda x: CASE WHEN x IN ({numbers}) THEN '0' ELSE x END)"
    bare = lambda x: f"translate({x}, '{d.START}', '')"
    slot = f"(starts_with(mine, '§') OR starts_with(mine, '¤') OR regexp_matches(mine, '[0-9]') OR {bare('mine')} IN ({numbers}))"
    canon = lambda x: f"CASE WHEN starts_with({x}, '§') THEN regexp_replace({x}, '(?:§\\p{{Ll}}+)+', '§', 'g') WHEN starts_with({x}, '¤') THEN '¤' WHEN {bare(x)} IN ({numbers}) THEN '0' ELSE regexp_replace({bare(x)}, '{d._VALUE_RE}', '0', 'g') END"
    is_start, is_name = lambda x: f"starts_with({x}, '{d.START}')", lambda x: f"starts_with({x}, '§')"
    cut = lambda x: f"array_to_string(list_slice({x}, k, k + w - 1), ' ')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words(template)} AS t, {tokens(slots)} AS s FROM (SELECT DISTINCT doc_id, text FROM documents)),
    i AS (SELECT *, least(len(t), {d.WINDOW}) AS w FROM (SELECT row_number() OVER () AS q, item_id, {words(template)} AS t, {tokens(slots)} AS s
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) WHERE len(t) > 0),
    iw AS (SELECT q, w, k, {cut('t')} AS win, {bare(cut('s'))} AS vals, len(list_filter(list_slice(t, k, k + w - 1), lambda x: x NOT IN ('§', '¤',
    '0'))) >= {d.LITERALS} AS literal
           FROM (SELECT q, w, t, s, unnest(range(1, len(t) - w + 2)) AS k FROM i)),
    dw AS (SELECT r, w, k, {cut('t')} AS win, {bare(cut('s'))} AS vals FROM (SELECT r, w, t, s, unnest(range(1, len(t) - w + 2)) AS k FROM d,
    (SELECT DISTINCT w FROM i) WHERE len(t) >= w)),
    h AS (SELECT r, q, dw.k - iw.k AS off FROM dw JOIN iw ON dw.w = iw.w AND dw.win = iw.win AND literal
          UNION SELECT r, q, dw.k - iw.k FROM dw JOIN iw ON dw.w = iw.w AND dw.vals = iw.vals AND NOT literal),
    p AS (SELECT h.r, h.q, off, d.doc_id, i.item_id, len(i.t) AS size, unnest(range(1, len(i.s) + 1)) AS j, d.s AS ds, i.s AS si FROM h
    JOIN d USING (r) JOIN i USING (q)),
    b AS (SELECT r, q, off, doc_id, item_id, size, si[j] AS mine, ds[j + off] AS theirs FROM p WHERE j + off >= 1 AND j + off <= len(ds)),
    a AS (SELECT * FROM b WHERE {canon('mine')} = {canon('theirs')} OR {is_start('mine')} AND ({is_start('theirs')} OR {is_name('theirs')}) OR {is_name('mine')} AND {is_start('theirs')}),
    g AS (SELECT r, q, off, doc_id, item_id, size, count(*) AS n, count(DISTINCT (mine, theirs)) FILTER (WHERE {slot}) AS pairs, count(DISTINCT mine)
    FILTER (WHERE {slot}) AS mines FROM a GROUP BY ALL)
    SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS n_tokens, CAST(max(pairs) AS INTEGER) AS n_slots
    FROM g WHERE pairs = mines AND n >= least(size, {d.MIN_TOKENS}) GROUP BY r, doc_id, item_id"""


def _op5_sql() -> str:
    """Windows as strings; each word's place is marked where a repeated window covers it."""
    w = substring.WINDOW
    return f"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    win AS (SELECT doc_id, k, array_to_string(list_slice(words, k, k + {w - 1}), ' ') AS s FROM (SELECT doc_id, words, unnest(range(1,
    len(words) - {w - 2})) AS k FROM d WHERE len(words) >= {w})),
    first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + {w})) AS j FROM win JOIN first USING (s) WHERE least < doc_id),
    each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
    SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT
    JOIN kept USING (doc_id)"""


def _op12_sql() -> str:
    """Targets by a join of sources with those before them; the order and its running sum by windows over all documents."""
    m = mixing

    def time(knots: tuple[tuple[float, float], ...]) -> str:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        cases, before = "", 0.0
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            rest = f"greatest(share * {sum(areas)}::DOUBLE - {before}::DOUBLE, 0)"
            root = f"({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {2 * (w1 - w0) / (t1 - t0)}::DOUBLE * {rest}, 0)))"
            before += area
            cases += f" WHEN share * {sum(areas)}::DOUBLE <= {before}::DOUBLE OR {t1} = 1 THEN least({t0}::DOUBLE + 2 * {rest} / {root}, {t1})"
        return f"CASE{cases} END"

    weight = "[" + ", ".join(map(str, m.WEIGHTS)) + f"][1 + place % {len(m.WEIGHTS)}]"
    positions = " ".join(f"WHEN {i} THEN {time(k)}" for i, k in enumerate(m.SCHEDULES))
    return rf"""
    WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
    w AS (SELECT *, {weight} AS w, sum(size) OVER () AS words FROM s),
    l AS (SELECT a.place, {m.REPEATS} * a.size * sum(b.w) FILTER (WHERE b.size * a.w >= a.size * b.w)
            <= a.w * (any_value(a.words) - coalesce(sum({m.REPEATS} * b.size) FILTER (WHERE b.size * a.w < a.size * b.w), 0)) AS stops
          FROM w a CROSS JOIN w b GROUP BY a.place, a.size, a.w),
    f AS (SELECT w.*, stops, words - coalesce(sum({m.REPEATS} * size) FILTER (WHERE stops) OVER (), 0) AS free, sum(w) FILTER (WHERE NOT stops) OVER () AS over FROM w JOIN l USING (place)),
    q AS (SELECT source, place, CAST(size AS BIGINT) AS source_size, CASE WHEN stops THEN CAST({m.REPEATS} * size AS DOUBLE) ELSE CAST(free * w AS DOUBLE) / CAST(over AS DOUBLE) END AS target,
          CAST(CASE WHEN stops THEN {m.REPEATS} * size ELSE CAST(free AS HUGEINT) * w // CAST(over AS HUGEINT) END AS BIGINT) AS quota FROM f),
    o AS (SELECT *, row_number() OVER o AS rank, CAST(sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before FROM d
          WINDOW o AS (PARTITION BY source ORDER BY md5('{m.SEED}' || coalesce(':' || doc_id, '')), doc_id, md5(text), size)),
    e AS (SELECT o.* EXCLUDE (source, text), place, source_size, target, quota, unnest(range({m.REPEATS})) AS e FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source),
    n AS (SELECT *, greatest(0, least(size, quota - e * source_size - before)) AS n FROM e),
    h AS (SELECT *, (e * source_size + before + n / 2) / quota AS share FROM n WHERE n > 0),
    t AS (SELECT *, CASE place % {len(m.SCHEDULES)} {positions} END AS position FROM h),
    p AS (SELECT *, CAST(sum(n) OVER (ORDER BY position, place, e, rank ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start FROM t),
    a AS (SELECT place, rank, sum(n) AS taken, min(start) AS first_start, min(position) AS first_position, max(position) AS last_position FROM p GROUP BY ALL)
    SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_start, first_position, last_position
    FROM (SELECT * FROM e WHERE e = 0) LEFT JOIN a USING (place, rank)"""


def _op13_sql() -> str:
    """Shares in 128-bit integers; every pair of a language's sources over every kept term."""
    d = divergence
    share = lambda n, whole: f"1 + ({d.SCALE}::HUGEINT * ({n} + {d.PRIOR})) // ({whole})"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    s AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS have, {share('coalesce(c.n, 0)', f's.n + {d.PRIOR} * v.v')} AS p, {share('k.total', f'v.n + {d.PRIOR} * v.v')} AS q
          FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE have > 0 AND p > q),
    y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 50"""


ORACLES = {"op2_decontamination": _op2_sql(), "op5_repeated_passages": _op5_sql(), "op9_url_vocabulary": _op9_sql(), "op12_curriculum": _op12_sql(), "op13_divergence": _op13_sql()}
