"""Framework symbols, lint rules, commands and flags."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINT_LINE_CHARS, lint_tokens, suppressed
from .python_code import _call_name, _each, _text

SYMBOL = "path string, module string, version string, qualified_name string, kind string, signature string, line int, status string"
FLAG = "path string, module string, version string, command string, flag string, default string, type string, help string"


def symbol_rows(source: str | None) -> list[dict]:
    """Public classes, functions and methods; a deprecation decorator or warning marks them."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []

    def row(node, prefix: str, kind: str) -> dict:
        marks = any(_call_name(d) == "deprecated" for d in node.decorator_list) or any(isinstance(x,
            ast.Name) and x.id == "DeprecationWarning" for x in ast.walk(node) if not isinstance(node, ast.ClassDef))
        signature = ast.unparse(node.args) if hasattr(node, "args") else None
        return {"qualified_name": prefix + node.name, "kind": kind, "signature": signature, "line": node.lineno, "status": "deprecated" if marks else "stable"}

    out = []
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            out.append(row(n, "", "class"))
            out += [row(m, f"{n.name}.", "method") for m in n.body if isinstance(m, ast.FunctionDef) and not m.name.startswith("_")]
        elif isinstance(n, ast.FunctionDef) and not n.name.startswith("_"):
            out.append(row(n, "", "function"))
    return out


def symbols(files: DataFrame) -> DataFrame:
    return _each(files, SYMBOL, symbol_rows)


def prefer_parsed(parsed: DataFrame, curated: DataFrame) -> DataFrame:
    """Parsed symbols, and curated ones that parsing didn't find."""
    keys = ["qualified_name", "version"]
    return parsed.unionByName(curated.join(parsed.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def flag_rows(source: str | None) -> list[dict]:
    """Options of option parsers, with the command class around them."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    tops = [(n.name.lower(), n) for n in tree.body if isinstance(n, ast.ClassDef)] + [("server", n) for n in tree.body if not isinstance(n, ast.ClassDef)]
    for command, top in tops:
        for call in (x for x in ast.walk(top) if isinstance(x, ast.Call) and _call_name(x) in ("add_argument", "add_option")):
            kw = {k.arg: k.value for k in call.keywords if k.arg}
            default = kw.get("my_default", kw.get("default"))
            for flag in (w for a in call.args if (w := _text(a)) and w.startswith("--")):
                out.append({"command": command, "flag": flag, "default": None if default is None else ast.unparse(default),
                    "type": ast.unparse(kw["type"]) if "type" in kw else None, "help": _text(kw.get("help"))})
    return out


def flags(files: DataFrame) -> DataFrame:
    return _each(files, FLAG, flag_rows)


def lint_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON files with a declared schema."""
    return spark.read.option("multiLine", True).schema(
        "rule_id string, version string, kind string, message string, severity string, file_pattern string, fix_template string, core_symbol string, code_pattern string").json(path)


def curated_symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(
        "qualified_name string, kind string, version string, signature string, status string, replacement string").json(path)


def check_lines(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, line, rule_id, match) where a rule fits a line and no noqa mark of that line covers it.

    A rule's pattern is a Python regular expression, so lines are searched in Arrow batches in Python. A rule without a pattern, or with one that
    doesn't compile, fits lines that share two words with its message; where none does but the whole file shares them, it is told of the first line.
    ``rules`` is a curated list (rule_id, code_pattern, message) and goes with the tasks; ``lines`` has (path, line, text). Lines of over
    ``LINT_LINE_CHARS`` characters are not searched for patterns.
    """
    listed = rules.select("rule_id", *[F.col(c) if c in rules.columns else F.lit(None).cast("string").alias(c) for c in ("code_pattern", "message")])
    known = [(r.rule_id, r.code_pattern, r.message) for r in listed.collect()]
    patterns, fuzzy = [], []
    for rule, pattern, message in known:
        try:
            patterns.append((rule, re.compile(pattern))) if pattern else fuzzy.append((rule, message))
        except re.error:
            fuzzy.append((rule, message))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [[i for i, p in patterns if len(t) <= LINT_LINE_CHARS and p.search(t)] for t in (x or "" for x in b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.string()))], [*b.schema.names, "hits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.select("path", "line", "text").schema)
    found = lines.select("path", "line", "text").mapInArrow(search, f"{kinds}, hits array<string>").select("path", "line", "text",
        F.explode("hits").alias("rule_id"), F.lit("pattern").alias("match"))
    if fuzzy:
        # words of a file are counted by rule, so no file meets in one value
        words = lines.sparkSession.createDataFrame(fuzzy, "rule_id string, message string").select("rule_id",
            F.explode(lint_tokens(F.col("message"))).alias("word"))
        shared = lines.select("path", "line", "text", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z_]+"))).alias("word")).join(
            F.broadcast(words), "word")
        by_line = shared.groupBy("path", "line", "text", "rule_id").agg(F.count("word").alias("n")).filter("n >= 2").select("path", "line", "text",
            "rule_id", F.lit("fuzzy").alias("match"))
        by_file = shared.groupBy("path", "rule_id").agg(F.count_distinct("word").alias("n")).filter("n >= 2").join(
            by_line.select("path", "rule_id").distinct(), ["path", "rule_id"], "left_anti")
        first = lines.filter("line = 1").select("path", "line", "text").join(by_file.select("path", "rule_id"), "path").select("path", "line", "text",
            "rule_id", F.lit("fuzzy").alias("match"))
        found = found.union(by_line).union(first)
    return found.filter(~suppressed(F.col("text"), F.col("rule_id"))).select("path", "line", "rule_id", "match")
