"""Models, fields, methods and tests from Python source, parsed in tasks over (path, module, version, content) rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.lineage import dealt, shuffled

MEMBER = "path string, module string, version string, model string, is_definition boolean, inherit array<string>, inherits map<string,string>, kind string, name string, line int, ttype string, comodel string, compute string, related string, required boolean, readonly boolean, inverse string, label string, decorators array<string>, depends array<string>, has_super boolean, field_refs array<string>"
TEST = "path string, module string, version string, test_class string, bases array<string>, tagged array<string>, name string, line int, asserts int, via string, model_refs array<string>, field_refs array<string>, method_refs array<string>"


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _words(node: ast.AST | None) -> list[str]:
    if (one := _text(node)) is not None:
        return [one]
    return [w for x in node.elts if (w := _text(x)) is not None] if isinstance(node, (ast.List, ast.Tuple)) else []


def _call_name(node: ast.AST) -> str:
    f = node.func if isinstance(node, ast.Call) else node
    return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""


def _flag(node: ast.AST | None) -> bool | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, bool) else None


def _field(name: str, call: ast.Call) -> dict:
    kw = {k.arg: k.value for k in call.keywords if k.arg}
    ttype = _call_name(call).lower()
    relational = ttype in ("many2one", "one2many", "many2many")
    first = _text(call.args[0]) if call.args else None
    return {
        "kind": "field", "name": name, "line": call.lineno, "ttype": ttype, "comodel": (_text(
            kw.get("comodel_name")) or first) if relational else None, "compute": _text(kw.get("compute")),
                "related": _text(kw.get("related")) or (".".join(_words(kw["related"])) if "related" in kw else None),
        "required": bool(_flag(kw.get("required"))), "readonly": _flag(kw.get("readonly")), "inverse": _text(kw.get("inverse")),
            "label": _text(kw.get("string")) or (None if relational else first),
    }


def _method(node: ast.FunctionDef) -> dict:
    inside = list(ast.walk(node))
    calls = [x for x in inside if isinstance(x, ast.Call)]
    depends = [w for d in node.decorator_list if isinstance(d, ast.Call) and _call_name(d) == "depends" for a in d.args for w in _words(a)]
    refs = {x.attr for x in inside if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self"}
    return {"kind": "method", "name": node.name, "line": node.lineno, "decorators": [_call_name(d) for d in node.decorator_list], "depends": depends,
        "has_super": any(isinstance(c.func, ast.Name) and c.func.id == "super" for c in calls), "field_refs": sorted(refs)}


def parse_modern(source: str) -> list[dict]:
    """Member rows of source that this Python can parse; a model without members has one row of kind ``model``."""
    out = []
    for cls in (n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.ClassDef)):
        own = {t.id: n.value for n in cls.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
        name, inherit = _text(own.get("_name")), _words(own.get("_inherit"))
        if not name and not inherit:
            continue
        d = own.get("_inherits")
        via = {k: v for a, b in zip(d.keys, d.values) if (k := _text(a)) and (v := _text(b))} if isinstance(d, ast.Dict) else {}
        head = {"model": name or inherit[0], "is_definition": bool(name) and name not in inherit, "inherit": inherit, "inherits": via}
        fields = [_field(k, v) for k, v in own.items() if isinstance(v, ast.Call) and isinstance(v.func, ast.Attribute) and isinstance(v.func.value,
            ast.Name) and v.func.value.id == "fields"]
        rows = fields + [_method(n) for n in cls.body if isinstance(n, ast.FunctionDef)]
        out += [head | r for r in rows or [{"kind": "model", "name": head["model"], "line": cls.lineno}]]
    return out


_CLASS = re.compile(r"^class\s+\w+.*?:\s*$", re.M)


def parse_legacy(source: str) -> list[dict]:
    """The same by line shapes, for source of older Pythons: old and new field styles, and methods."""
    out = []
    starts = [m.start() for m in _CLASS.finditer(source)]
    for a, z in zip(starts, [*starts[1:], len(source)]):
        body, base = source[a:z], source.count("\n", 0, a)
        one = re.search(r"^\s+_name\s*=\s*['\"]([\w.]+)['\"]", body, re.M)
        inh = re.search(r"^\s+_inherit\s*=\s*(\[[^\]]*\]|['\"][\w.]+['\"])", body, re.M)
        inherit = re.findall(r"['\"]([\w.]+)['\"]", inh[1]) if inh else []
        if not one and not inherit:
            continue
        name = one[1] if one else None
        via = re.search(r"^\s+_inherits\s*=\s*\{([^}]*)\}", body, re.M)
        via = dict(re.findall(r"""['"]([\w.]+)['"]\s*:\s*['"](\w+)['"]""", via[1])) if via else {}
        head = {"model": name or inherit[0], "is_definition": bool(name) and name not in inherit, "inherit": inherit, "inherits": via}
        rows = []
        for m in re.finditer(r"""(?:['"](\w+)['"]\s*:|^\s+(\w+)\s*=)\s*fields\.(\w+)\(\s*(?:['"]([\w. ]+)['"])?""", body, re.M):
            ttype = m[3].lower()
            rows.append({"kind": "field", "name": m[1] or m[2], "line": base + body.count("\n", 0, m.start(3)) + 1, "ttype": ttype,
                "comodel": m[4] if ttype in ("many2one", "one2many", "many2many") else None, "required": False})
        heads = list(re.finditer(r"^\s+def\s+(\w+)\s*\(", body, re.M))
        for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(body)]):
            code = re.sub(r"#[^\n]*", "", body[m.end() : end])
            rows.append({"kind": "method", "name": m[1], "line": base + body.count("\n", 0, m.start(1)) + 1, "has_super": bool(re.search(r"\bsuper\s*\(", code))})
        out += [head | r for r in rows or [{"kind": "model", "name": head["model"], "line": base + 1}]]
    return out


def parse_source(source: str | None) -> list[dict]:
    try:
        return parse_modern(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return parse_legacy(source or "")


def _each(files: DataFrame, schema: str, parse) -> DataFrame:
    """Rows that ``parse`` makes of each file's content, as Arrow batches: no data frame is built in between.

    Parsing costs far more than reading, and thousands of files fit one split of a table: they are dealt over tasks by their path first.
    """
    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    maps = {k.name for k in kinds if pa.types.is_map(k.type)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = zip(*(b.column(c).to_pylist() for c in ("path", "module", "version", "content")))
            rows = [{"path": p, "module": m, "version": v} | r for p, m, v, c in columns for r in parse(c)]
            value = lambda r, name: list(r[name].items()) if name in maps and r.get(name) is not None else r.get(name)
            yield pa.RecordBatch.from_arrays([pa.array([value(r, k.name) for r in rows], k.type) for k in kinds], schema=kinds)

    return dealt(files.select("path", "module", "version", "content"), "path").mapInArrow(run, schema)


def members(files: DataFrame) -> DataFrame:
    """A row for each field and method; source that doesn't parse goes through the legacy shapes."""
    return _each(files, MEMBER, parse_source)


def inherit_edges(rows: DataFrame) -> DataFrame:
    """INHERITS and DELEGATES_TO edges of parsed models; ``order`` is the place in the inherit list."""
    # both kinds come from one pass over the rows, since each pass would parse the files anew; a list counts once for each model and module that has it
    edge = lambda order, dst, kind, via, held: F.struct(order.cast("int").alias("order"), dst.alias("dst"), F.lit(kind).alias("kind"),
        via.cast("string").alias("via_field"), held.cast("array<string>").alias("_list"))
    none = F.lit(None)
    up = F.transform("inherit", lambda x, i: edge(i, x, "INHERITS", none, F.col("inherit")))
    via = F.transform(F.map_entries("inherits"), lambda e: edge(none, e["key"], "DELEGATES_TO", e["value"], none))
    found = rows.select("model", "module", "version", F.explode(F.array_compact(F.array(up, via))).alias("_edges")).select("model", "module", "version", F.inline("_edges"))
    return found.distinct().select("model", "module", "version", "order", "dst", "kind", "via_field").filter(F.col("dst") != F.col("model"))


#: Methods that set a test up or take it down.
FIXTURES = ("setUp", "setUpClass", "tearDown", "tearDownClass")


def _test_rows(source: str | None) -> list[dict]:
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for cls in (n for n in tree.body if isinstance(n, ast.ClassDef)):
        bases = [_call_name(b) for b in cls.bases]
        tags = [w for d in cls.decorator_list if isinstance(d, ast.Call) and _call_name(d) == "tagged" for a in d.args for w in _words(a)]
        for fn in (n for n in cls.body if isinstance(n, ast.FunctionDef)):
            inside = list(ast.walk(fn))
            calls = [x for x in inside if isinstance(x, ast.Call)]
            asserts = sum(_call_name(c).startswith("assert") for c in calls)
            models = {w for x in inside if isinstance(x, ast.Subscript) and isinstance(x.value, ast.Attribute) and x.value.attr == "env" and (
                w := _text(x.slice))}
            via = "setup" if fn.name in FIXTURES else "assert" if fn.name.startswith("test_") else "body"
            attrs = {x.attr for x in inside if isinstance(x, ast.Attribute)}
            called = {c.func.attr for c in calls if isinstance(c.func, ast.Attribute)}
            out.append({"test_class": cls.name, "bases": bases, "tagged": tags, "name": fn.name, "line": fn.lineno, "asserts": asserts, "via": via,
                "model_refs": sorted(models), "field_refs": sorted(attrs - called), "method_refs": sorted(called)})
    return out


def tests(files: DataFrame) -> DataFrame:
    """A row for each method of a test class, with what it refers to by name."""
    return _each(files, TEST, _test_rows)


USE = "path string, module string, version string, test_class string, test string, line int, via string, model string, name string, called boolean, asserted boolean"
#: Methods that give records of the model they are called on.
SAME_MODEL = frozenset("browse copy create exists filtered new search sorted sudo with_company with_context with_env with_user".split())


class _Flow(ast.NodeVisitor):
    """Definitions and uses of one method: which names hold records of which model, and which of the model's members are read or called.

    Statements are taken in order. A name that is given another value loses its model; what is set on ``self`` or ``cls`` in a fixture
    holds in all tests of the class.
    """

    def __init__(self, known: dict[str, str]):
        self.known, self.uses, self.asserts = dict(known), [], 0

    def model(self, e: ast.AST) -> str | None:
        if isinstance(e, ast.Subscript) and isinstance(e.value, ast.Attribute) and e.value.attr == "env":
            return _text(e.slice)
        if isinstance(e, ast.Name):
            return self.known.get(e.id)
        if isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name) and e.value.id in ("self", "cls"):
            return self.known.get(f"self.{e.attr}")
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and e.func.attr in SAME_MODEL:
            return self.model(e.func.value)
        return None

    def _set(self, target: ast.AST, model: str | None) -> None:
        name = target.id if isinstance(target, ast.Name) else None
        if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id in ("self", "cls"):
            name = f"self.{target.attr}"
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self._set(t, None)
        if name and model:
            self.known[name] = model
        elif name:
            self.known.pop(name, None)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        model = self.model(node.value)
        for t in node.targets:
            if isinstance(t, ast.Attribute):
                self.visit(t)
            self._set(t, model)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self.visit(node.value)
            self._set(node.target, self.model(node.value))

    def visit_For(self, node: ast.For) -> None:
        self.visit(node.iter)
        self._set(node.target, self.model(node.iter))  # records are walked one by one
        for x in node.body + node.orelse:
            self.visit(x)

    def visit_Call(self, node: ast.Call) -> None:
        inside = _call_name(node).startswith("assert")
        self.asserts += inside
        if isinstance(node.func, ast.Attribute):
            self._use(node.func, True)
            self.visit(node.func.value)
        for x in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(x)
        self.asserts -= inside

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self._use(node, False)
        self.visit(node.value)

    def _use(self, node: ast.Attribute, called: bool) -> None:
        if (model := self.model(node.value)) and not node.attr.startswith("_"):
            self.uses.append((node.lineno, model, node.attr, called, self.asserts > 0))


def use_rows(source: str | None) -> list[dict]:
    """Uses of model members in the methods of test classes, by def-use chains from ``env[...]``; source that doesn't parse has none."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for cls in (n for n in tree.body if isinstance(n, ast.ClassDef)):
        methods = sorted((n for n in cls.body if isinstance(n, ast.FunctionDef)), key=lambda n: (n.name != "setUpClass", n.name != "setUp"))
        shared: dict[str, str] = {}
        for fn in methods:
            flow = _Flow(shared)
            for x in fn.body:
                flow.visit(x)
            if fn.name in ("setUp", "setUpClass"):
                shared = {k: v for k, v in flow.known.items() if k.startswith("self.")}
            via = "setup" if fn.name in FIXTURES else "assert" if fn.name.startswith("test_") else "body"
            out += [{"test_class": cls.name, "test": fn.name, "line": line, "via": via, "model": m, "name": a, "called": c, "asserted": t} for line, m, a, c, t in dict.fromkeys(flow.uses)]
    return out


def uses(files: DataFrame) -> DataFrame:
    """A row for each place where a test reads or calls a member of a model that is known there."""
    return _each(files, USE, use_rows)


def coverage(used: DataFrame, members: DataFrame) -> DataFrame:
    """Test -> member edges, in every module that defines the model's member: (test_class, test, model, name, module, via, asserted).

    ``members``: model, name, module, kind (field or method). A member that is only named like one of another model's is not covered.
    """
    kind = F.when(F.col("called"), "method").otherwise("field")
    refs = used.groupBy("test_class", "test", "model", "name", kind.alias("kind"), "via").agg(F.max("asserted").alias("asserted"))
    return refs.join(shuffled(members.select("model", "name", "kind", "module").distinct()), ["model", "name", "kind"]).select("test_class", "test", "model", "name", "module", "via", "asserted")
