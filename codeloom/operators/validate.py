"""Checks of domains, dependency lists and relations against the model graph, with suggestions for wrong names."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import RELATIONAL, is_domain_operator
from .alike import nearest
from .graph import is_subtype, walk_paths
from .lineage import cut, dealt

#: Fixed value: how alike two names are at least, where one is suggested for the other.
ALIKE = 0.7
#: Strings that join a domain's terms.
CONNECTORS = ("&", "|", "!")


#: Names of one key, wanted ones and candidates, that one task compares at most, about.
BLOCK_NAMES = 20_000


def suggest(wanted: DataFrame, candidates: DataFrame, key: str, name: str = "name") -> DataFrame:
    """``wanted`` (key, name) with ``suggestion``: the most alike of the key's candidate names, if any is alike enough.

    Of equally alike names the last by order wins. A key's names are dealt into blocks of about ``BLOCK_NAMES``, and every block of wanted names meets every
    block of candidates in a task of its own: names travel once for each such block, pairs never. A name is compared with a
    tree of the candidates, whose branches are left where their letters in order can't be alike enough.
    """
    w = wanted.select(key, F.col(name).alias("_name")).filter("_name <> ''").distinct()
    c = candidates.select(key, F.col(name).alias("_name")).filter("_name <> ''").distinct()
    blocks = lambda d, n: d.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_NAMES).cast("int").alias(n))
    sizes = cut(blocks(w, "_nw").join(blocks(c, "_nc"), key))
    own = lambda n: F.pmod(F.xxhash64("_name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = w.join(sizes, key).select(key, "_name", own("_nw").alias("_w"), every("_nc").alias("_c"))
    right = c.join(sizes, key).select(key, "_name", own("_nc").alias("_c"), every("_nw").alias("_w"))
    kind = wanted.schema[key].dataType.simpleString()

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names, other = mine.column("_name").to_pylist(), theirs.column("_name").to_pylist()
        best = nearest(names, other, ALIKE) if names and other else [None] * len(names)
        rows = [(k, n, *b) for k, n, b in zip(mine.column(key).to_pylist(), names, best) if b]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(columns[0], mine.schema.field(key).type), *(pa.array(x, t) for x, t in zip(columns[1:], (pa.string(), pa.float64(), pa.string())))],
            [key, "_name", "_ratio", "_candidate"])

    at = [key, "_w", "_c"]
    rated = dealt(left, *at).groupBy(*at).cogroup(dealt(right, *at).groupBy(*at)).applyInArrow(compare, f"`{key}` {kind}, _name string, _ratio double, _candidate string")
    best = rated.groupBy(key, F.col("_name").alias(name)).agg(F.max(F.struct("_ratio", "_candidate"))["_candidate"].alias("suggestion"))
    return wanted.join(best, [key, name], "left")


TERM = "at int, kind string, path string, operator string"


def _terms(text: str | None) -> list[tuple[int, str, str | None, str | None]]:
    """Terms of a domain literal; kind: term, connector, word (another string), malformed, no_path, unreadable."""
    try:
        parsed = ast.literal_eval((text or "").strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return [(-1, "unreadable", None, None)]
    if not isinstance(parsed, (list, tuple)):
        return [(-1, "unreadable", None, None)]
    out = []
    for i, t in enumerate(parsed):
        if isinstance(t, str):
            out.append((i, "connector" if t in CONNECTORS else "word", None, None))
        elif not isinstance(t, (list, tuple)) or len(t) != 3:
            out.append((i, "malformed", None, None))
        else:
            out.append((i, "term" if isinstance(t[0], str) else "no_path", t[0] if isinstance(t[0], str) else None, t[1] if isinstance(t[1], str) else None))
    return out


def domain_terms(domains: DataFrame, text: str = "domain") -> DataFrame:
    """All other columns of ``domains`` and (at, kind, path, operator) of each term; a domain that can't be read has one row with ``at`` -1."""
    rest = [c for c in domains.columns if c != text]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("path", pa.string()), ("operator", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [[dict(zip(("at", "kind", "path", "operator"), t)) for t in _terms(x)] for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(terms, kind)], [*rest, "terms"])

    schema = ", ".join(f"{c} {domains.schema[c].dataType.simpleString()}" for c in rest)
    parsed = domains.mapInArrow(parse, f"{schema}, terms array<struct<at:int,kind:string,path:string,operator:string>>")
    return parsed.select(*rest, F.inline("terms"))


def check_domains(domains: DataFrame, members: DataFrame) -> DataFrame:
    """(id, at, path, operator, problem): what is wrong with each term of ``domains`` (id, model, version, domain); null where nothing is.

    A path must resolve hop by hop, and the version must know the operator. Connectors are passed over; both problems of a term are told.
    """
    terms = domain_terms(domains)
    paths = terms.filter("kind = 'term'").select("model", "path").distinct()
    walked = walk_paths(paths, members).select(F.col("model").alias("_m"), F.col("path").alias("_p"), "status")
    joined = terms.filter("kind <> 'connector'").join(walked, (F.col("model") == F.col("_m")) & (F.col("path") == F.col("_p")), "left")
    path = F.when(F.col("kind") == "term", F.when(F.col("status") != "ok", F.col("status"))).otherwise(F.col("kind"))
    operator = F.when(F.col("kind").isin("term", "no_path") & ~is_domain_operator(F.col("operator"), F.col("version")), "unknown_operator")
    problem = F.nullif(F.concat_ws(",", path, operator), F.lit(""))
    return joined.select("id", "at", "path", "operator", problem.alias("problem"))


def check_depends(methods: DataFrame, members: DataFrame) -> DataFrame:
    """(model, name, dependency, problem) of every dependency path of ``methods`` (model, name, depends); overrides of one method are united.

    A path through ``id`` is an error whatever it leads to.
    """
    deps = methods.select("model", "name", F.explode("depends").alias("dependency")).distinct()
    walked = walk_paths(deps.select("model", F.col("dependency").alias("path")).distinct(), members).select("model",
        F.col("path").alias("dependency"), "status")
    by_id = F.array_contains(F.split("dependency", r"\."), "id")
    return deps.join(walked, ["model", "dependency"]).select("model", "name", "dependency",
        F.when(by_id, "depends_on_id").when(F.col("status") != "ok", F.col("status")).alias("problem"))


def check_relations(wanted: DataFrame, members: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """``wanted`` (model, field, target) with ``status``: ok, missing, not_relational, no_comodel or mismatch.

    A relation to the target itself or to something that inherits it within ``hops`` is ok.
    """
    have = members.select("model", F.col("name").alias("field"), F.lower("ttype").alias("ttype"), "comodel", F.lit(True).alias("_found"))
    rows = wanted.join(have, ["model", "field"], "left")
    pairs = rows.filter("comodel is not null").select("comodel", "target").distinct()
    sub = is_subtype(pairs, edges, hops).withColumnsRenamed({"comodel": "_c", "target": "_t"})
    rows = rows.join(sub, (F.col("comodel") == F.col("_c")) & (F.col("target") == F.col("_t")), "left")
    status = F.when(F.col("_found").isNull(), "missing").when(~F.col("ttype").isin(*RELATIONAL), "not_relational").when(F.col("comodel").isNull(),
        "no_comodel").when(F.coalesce("ok", F.lit(False)), "ok").otherwise("mismatch")
    return rows.select("model", "field", "target", status.alias("status"))
