"""Example search as one answer: literal names first, then nearest vectors, or keywords where a query has no vector; reranked by dependents and context.

Vectors meet in blocks of queries and of chunks, each pair of blocks in a task of its own that keeps the best rows of every query. For names and keywords a block of queries
is sent to every task; chunks are scanned once for each block and way of searching and never shuffled, since each task keeps its own best rows of a query before the few that
are left meet. What follows is done once for all queries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import keywords, literal_column, style_literal
from .graph import closure
from .lineage import cut, dealt
from .search import CENTRALITY, CLOSURE_BONUS, LITERAL_FLOOR, LITERAL_STEP
from .store import UNRESOLVED

#: Rows that a search considers at most; kinds of style and of test chunks.
SEARCHED = 20
STYLE_KINDS = ("css", "scss", "less")
TEST_KINDS = ("test_method", "test_class", "js_test")
#: Kinds of tests by how they run, as a caller names them.
BACKEND_TESTS = ("transaction", "http", "form", "savepoint")
#: Queries of one block, at most; more of them are dealt into blocks of about half as many. Chunks of one block, about.
BLOCK, CHUNKS = 1000, 2000
#: Queries of a block whose products with its chunks are held at once; more than products of unit vectors are off by rounding.
HELD, NEARLY = 128, 1e-9

ASK = "ask long, text string, version string, kinds array<string>, allowed array<string>, context string, k int, vec array<float>"


def _contains(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def routed(asks: DataFrame) -> DataFrame:
    """``asks`` with ``route`` (literal, semantic, lexical or none) and ``most``, the rows to look for.

    A query of style kinds alone that is written as such a name is looked up literally, whether or not it has a vector. A blank query finds nothing.
    """
    style = (F.size("kinds") > 0) & F.forall("kinds", lambda c: c.isin(*STYLE_KINDS))
    route = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "none").when(F.coalesce(style, F.lit(False)) & style_literal(F.col("text")), "literal").when(
        F.col("vec").isNotNull(), "semantic").otherwise("lexical")
    return asks.withColumn("route", route).withColumn("most", F.least(F.col("k"), F.lit(SEARCHED)))


def _visible(asks: DataFrame, chunks: DataFrame, condition: Column) -> DataFrame:
    """Chunks that each ask may see and that fit: version, kinds (none: all) and profiles (null: all; an empty list denies all)."""
    a = asks.withColumnsRenamed({c: f"_{c}" for c in asks.columns})
    fits = (F.col("_version") == F.col("version")) & (F.coalesce(F.size("_kinds") < 1, F.lit(True)) | F.array_contains("_kinds", F.col("kind")))
    fits = fits & (F.col("_allowed").isNull() | F.coalesce(F.array_contains("_allowed", F.col("profile")), F.lit(False)))
    return chunks.join(F.broadcast(a), fits & condition)  # a counted block of queries


def _first(rows: DataFrame, order: list[Column]) -> DataFrame:
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("_ask").orderBy(*order)))
    return ranked.filter(F.col("place") <= SEARCHED).filter(F.col("place") <= F.col("_most"))


def find_examples(asks: DataFrame, chunks: DataFrame, depends: DataFrame, id_col: str = "id") -> DataFrame:
    """(ask, rank, id, match, score): the answers to each ask, best first.

    ``asks`` as ``ASK``; ``chunks``: id, kind, module, version, profile, entity_name, chunk_idx, content, embedding; ``depends``: src, dst, version.
    Literal rows stand above all semantic ones, in the order of their search; what they leave open is filled with semantic rows. The score of
    a semantic row grows with its module's dependents; modules that the ask's context depends on get a bonus. Placeholders' rows go after the search.
    """
    asks = cut(routed(asks))
    n = asks.agg(*[F.count_if(F.col("route") == r).alias(r) for r in ("literal", "lexical")], F.count_if(F.col("context").isNotNull()).alias("context")).first()
    slim = chunks.select(F.col(id_col).alias("id"), "kind", "module", "version", "profile", "entity_name", "chunk_idx", "content", "embedding")
    found = _nearest(asks.filter("route in ('literal', 'semantic')"), slim)
    if n.literal + n.lexical > BLOCK:
        slim = cut(slim.drop("embedding"))
    for route, search in (("literal", _literal), ("lexical", _lexical)):
        mine, blocks = asks.filter(F.col("route") == route), 1 if n[route] <= BLOCK else -(-2 * n[route] // BLOCK)
        part = lambda i: mine.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == i)  # noqa: B023, E731
        if n[route]:
            found = reduce(DataFrame.union, [search(part(i), slim) if blocks == 1 else cut(search(part(i), slim)) for i in range(blocks)], found)
    return _ranked(asks, found, depends, bool(n.context))


def _short() -> list[Column]:
    return [F.length("entity_name"), F.col("module"), F.col("chunk_idx"), F.col("id")]


def _found() -> list[Column]:
    return [F.col("_ask").alias("ask"), "id", "module", F.col("_version").alias("version"), F.col("_context").alias("context"), F.col("_most").alias("most"), "place", "match", "cosine"]


def _literal(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    named = F.when(literal_column(F.col("_text")) == "content", _contains(F.col("content"), F.trim("_text"))).otherwise(_contains(F.col("entity_name"), F.trim("_text")))
    return _first(_visible(asks, chunks, named), _short()).withColumn("match", F.lit("literal")).withColumn("cosine", F.lit(None).cast("double")).select(*_found())


def _lexical(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    words = asks.withColumn("words", keywords(F.col("text")))
    rows = _first(_visible(words, chunks, F.exists("_words", lambda w: _contains(F.col("entity_name"), w))), _short())
    return rows.withColumn("match", F.lit("lexical")).withColumn("cosine", F.lit(None).cast("double")).select(*_found())


def _dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of x with the rows ``j`` of y, added from the left as ``scalars.dot`` adds."""
    out = np.zeros(len(i))
    for d in range(x.shape[1]):
        out += x[i, d] * y[j, d]
    return out


def _near_rows(asks: pa.Table, chunks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the asks and chunks that belong together, and their cosines: of each ask its nearest visible chunks, ``_most`` at most; ties by id.

    Matrix products tell which can be among them; the cosines of these alone are computed in the order that decides.
    """
    vectors = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)
    a, b = vectors(asks.column("_vec")), vectors(chunks.column("embedding"))
    long = lambda x: np.sqrt(_dots(x, x, np.arange(len(x)), np.arange(len(x))))
    la, lb = long(a), long(b)
    unit_a, unit_b = a / np.where(la > 0, la, 1)[:, None], b / np.where(lb > 0, lb, 1)[:, None]
    most, at = asks.column("_most").to_numpy(), np.empty(len(b), np.int64)
    at[pc.sort_indices(chunks.column("id"), null_placement="at_start").to_numpy()] = np.arange(len(b))
    kind, profile = (np.array(chunks.column(c).to_pylist(), object) for c in ("kind", "profile"))
    alike: dict = {}
    for i, scope in enumerate(zip(asks.column("_kinds").to_pylist(), asks.column("_allowed").to_pylist())):
        if la[i] > 0:
            alike.setdefault(tuple(None if x is None else tuple(x) for x in scope), []).append(i)
    out = []
    for (kinds, allowed), mine in alike.items():
        fits = lb > 0
        for have, want in ((kind, kinds or None), (profile, allowed)):
            if want is not None:
                fits = fits & np.array([x is not None and x in want for x in have], bool)
        rows = np.flatnonzero(fits)
        for some in (np.array(mine[k : k + HELD]) for k in range(0, len(mine) if len(rows) else 0, HELD)):
            near = unit_a[some] @ unit_b[rows].T
            cut_at = max(len(rows) - int(most[some].max()), 0)
            i, j = np.nonzero(near >= np.partition(near, cut_at, 1)[:, cut_at, None] - NEARLY)
            i, j = some[i], rows[j]
            cos = _dots(a, b, i, j) / (la[i] * lb[j])
            order = np.lexsort((at[j], -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < most[i]
            out.append((i[best], j[best], cos[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _nearest(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The nearest chunks by cosine of the asks that have a vector. Vectors of another size, without length or with parts that are no numbers have no cosine."""
    size, whole = lambda v: F.size(v).alias("_size"), lambda v: (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    a = asks.filter(whole("vec") & F.col("version").isNotNull() & (F.col("most") > 0))
    a = a.select("version", size("vec"), *[F.col(c).alias(f"_{c}") for c in ("ask", "context", "most", "kinds", "allowed", "vec")])
    c = chunks.filter(whole("embedding") & F.col("version").isNotNull()).select("version", size("embedding"), "id", "kind", "module", "profile", "embedding")
    key = ["version", "_size"]
    blocks = lambda d, n, most: d.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(n))
    sizes = cut(blocks(a, "_na", BLOCK).join(blocks(c, "_nc", CHUNKS), key))
    own = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(sizes, key).select(*a.columns, own("_ask", "_na").alias("_a"), every("_nc").alias("_c"))
    right = c.join(sizes, key).select(*c.columns, own("id", "_nc").alias("_c"), every("_na").alias("_a"))
    fields = [("_ask", a.schema["_ask"]), ("id", c.schema["id"]), ("module", c.schema["module"]), ("_version", a.schema["version"]), ("_context", a.schema["_context"]), ("_most", a.schema["_most"])]
    types = [to_arrow_type(f.dataType) for _, f in fields]

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if mine.num_rows and theirs.num_rows:
            i, j, cos = _near_rows(mine, theirs)
        else:
            mine, theirs, i, j, cos = mine.slice(0, 0), theirs.slice(0, 0), *(np.zeros(0, x) for x in (np.int64, np.int64, float))
        source = (mine.column("_ask"), theirs.column("id"), theirs.column("module"), mine.column("version"), mine.column("_context"), mine.column("_most"))
        columns = [x.take(pa.array(k)).combine_chunks().cast(t) for x, k, t in zip(source, (i, j, j, i, i, i), types)]
        return pa.Table.from_arrays([*columns, pa.array(cos)], [*(n for n, _ in fields), "cosine"])

    at = [*key, "_a", "_c"]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in fields)
    near = dealt(left, *at).groupBy(*at).cogroup(dealt(right, *at).groupBy(*at)).applyInArrow(compare, f"{schema}, cosine double")
    return _first(near, [F.desc("cosine"), F.col("id")]).withColumn("match", F.lit("semantic")).select(*_found())


def _ranked(asks: DataFrame, found: DataFrame, depends: DataFrame, contexts: bool) -> DataFrame:
    """What was found for all asks, in its order with its scores; ``contexts`` tells whether any ask has one."""
    # a chunk that is found both ways counts as literal; then what is left is cut to the ask's size, literal rows first
    own = found.groupBy("ask", "id", "module", "version", "context", "most").agg(F.min(F.struct((F.col("match") == "semantic").alias("late"), "place", "match", "cosine")).alias("b"))
    order = Window.partitionBy("ask").orderBy("b.late", "b.place")
    raw = own.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("most")).filter(F.col("module") != UNRESOLVED)
    dependents = depends.select("src", F.col("dst").alias("module"), "version").distinct().groupBy("module", "version").agg(F.count(F.lit(1)).alias("dependents"))
    rows = raw.join(dependents, ["module", "version"], "left")
    if contexts:
        roots = asks.filter("context is not null").select(F.struct("context", "version").alias("root")).distinct()
        node = lambda c: F.struct(F.col(c).alias("context"), "version")
        below = closure(roots, depends.select(node("src").alias("src"), node("dst").alias("dst")), None)
        below = below.select(F.col("root.context").alias("context"), F.col("root.version").alias("version"), F.col("name.context").alias("module"), F.lit(True).alias("_near")).distinct()
        rows = rows.join(below, ["context", "version", "module"], "left")
    else:
        rows = rows.withColumn("_near", F.lit(None).cast("boolean"))
    literal_n = F.count_if(F.col("b.match") == "literal").over(Window.partitionBy("ask"))
    literal_at = F.row_number().over(Window.partitionBy("ask").orderBy("at")) - 1
    base = F.when(F.col("b.match") == "literal", LITERAL_FLOOR + (literal_n - literal_at) * LITERAL_STEP).when(
        F.col("b.match") == "semantic", F.col("b.cosine") * (1 + CENTRALITY * F.log1p(F.coalesce("dependents", F.lit(0)).cast("double"))))
    # keyword rows have no score; they keep the order of their search
    score = F.when(F.col("b.match") != "lexical", base + F.when(F.col("_near"), CLOSURE_BONUS).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc_nulls_last("score"), "at"))
    return rows.withColumn("score", score).withColumn("rank", rank).select("ask", "rank", "id", F.col("b.match").alias("match"), "score")


def test_kinds(kind: str | None) -> list[str]:
    """Chunk kinds of a test search: script suites, Python tests, or both."""
    return ["js_test"] if kind == "js" else ["test_method", "test_class"] if kind in BACKEND_TESTS else list(TEST_KINDS)


def find_test_examples(asks: DataFrame, chunks: DataFrame, depends: DataFrame, id_col: str = "id", texts: DataFrame | None = None) -> DataFrame:
    """``find_examples`` among test chunks alone; ``asks`` also has ``test_kind`` and ``model``. Rows that don't name the model, where one is asked for, go afterwards.

    ``texts`` (id, kind, entity_name, content) are the chunks', where they can be had without making all chunks.
    """
    narrowed = asks.withColumn("kinds", F.when(F.col("test_kind") == "js", F.array(F.lit("js_test"))).when(F.col("test_kind").isin(*BACKEND_TESTS),
        F.array(F.lit("test_method"), F.lit("test_class"))).otherwise(F.array(*[F.lit(k) for k in TEST_KINDS])))
    found = cut(find_examples(narrowed.drop("test_kind", "model"), chunks.filter(F.col("kind").isin(*TEST_KINDS)), depends, id_col))
    texts = (chunks if texts is None else texts).filter(F.col("kind").isin(*TEST_KINDS)).select(F.col(id_col).alias("id"), "entity_name", "content")
    texts = texts.join(found.select("id"), "id", "left_semi")  # of the chunks found alone
    named = found.join(asks.select("ask", "model"), "ask").join(texts, "id")
    about = F.col("model").isNull() | F.contains("entity_name", F.col("model")) | F.contains("content", F.col("model"))
    return named.filter(F.coalesce(about, F.lit(False))).select("ask", "rank", "id", "match", "score")
