"""Views, reports and templates from XML; chunks and graphs from JS, CSS, SCSS and LESS."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

from .python_code import _each

VIEW = "path string, module string, version string, kind string, xmlid string, name string, model string, view_type string, mode string, inherit_xmlid string, xpaths array<struct<expr:string,position:string>>, conditions array<struct<element:string,attr:string,expr:string,field:string,legacy:boolean>>, report_name string, report_type string, content string"
SCRIPT = "path string, module string, version string, kind string, era string, name string, target string, template string, extends string, bound_model string, content string"
SUITE = "path string, module string, version string, framework string, describe_blocks array<string>, test_names array<string>, tags array<string>, mounts array<string>"
STYLE = "path string, module string, version string, language string, kind string, name string, chunk_idx int, content string"

_CONDITIONS = ("invisible", "required", "readonly", "column_invisible")


def qualified(xmlid: str | None, module: str) -> str | None:
    return xmlid if not xmlid or "." in xmlid else f"{module}.{xmlid}"


def _conditions(arch: ET.Element) -> list[dict]:
    out = []
    for e in arch.iter():
        name = e.get("name") if e.tag == "field" else None
        for attr in _CONDITIONS:
            if e.get(attr) is not None:
                out.append({"element": e.tag, "attr": attr, "expr": e.get(attr), "field": name, "legacy": False})
        for attr in ("attrs", "states"):
            if e.get(attr) is not None:
                out.append({"element": e.tag, "attr": attr, "expr": e.get(attr), "field": name, "legacy": True})
    return out


def _view(record: ET.Element, f: dict[str, ET.Element]) -> dict:
    arch = f.get("arch")
    tops = list(arch) if arch is not None else []
    parent = f["inherit_id"].get("ref") if "inherit_id" in f else None
    xpaths = [{"expr": x.get("expr"), "position": x.get("position", "inside")} for x in (arch.iter("xpath") if arch is not None else ())]
    kind = tops[0].tag if tops and tops[0].tag not in ("xpath", "data") else None
    text = lambda k: (f[k].text or "").strip() or None if k in f else None
    return {"kind": "view", "xmlid": record.get("id"), "name": text("name"), "model": text("model"), "view_type": text("type") or kind,
        "mode": text("mode") or ("extension" if parent else "primary"), "inherit_xmlid": parent, "xpaths": xpaths,
            "conditions": _conditions(arch) if arch is not None else [], "content": ET.tostring(arch, encoding="unicode") if arch is not None else None}


def xml_rows(source: str | None, module: str) -> list[dict]:
    """Views, reports and templates; a file that isn't well formed gives none."""
    try:
        root = ET.fromstring(source or "")
    except (ET.ParseError, ValueError):
        return []
    out = []
    for e in root.iter():
        f = {x.get("name"): x for x in e if x.tag == "field"}
        if e.tag == "record" and e.get("model") == "ir.ui.view":
            out.append(_view(e, f))
        elif e.tag == "record" and e.get("model") == "ir.actions.report" or e.tag == "report":
            get = lambda k, a=None: (f[k].text if k in f else e.get(a or k))  # noqa: B023, E731
            out.append({"kind": "report", "xmlid": e.get("id"), "name": get("name", "string"), "model": get("model"),
                "report_name": get("report_name", "name"), "report_type": get("report_type")})
        elif e.tag == "template" or e.get("t-name"):
            out.append({"kind": "qweb", "xmlid": e.get("id") or e.get("t-name"), "name": e.get("name"),
                "inherit_xmlid": e.get("inherit_id") or e.get("t-inherit"), "mode": e.get("t-inherit-mode") or (
                    "extension" if e.get("inherit_id") else "primary"), "content": ET.tostring(e, encoding="unicode")})
    for r in out:
        r["xmlid"], r["inherit_xmlid"] = qualified(r["xmlid"], module), qualified(r.get("inherit_xmlid"), module)
    return out


def views(files: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    # the module is part of what a row is made from, so it goes along in the content
    packed = files.withColumn("content", F.concat_ws("\n", "module", "content"))
    return _each(packed, VIEW, lambda c: xml_rows((c or "\n").split("\n", 1)[-1], (c or "").split("\n", 1)[0]))


_SCRIPT_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[`/{}]|[\w$)\]]+|\S", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: Words after which a slash begins a regular expression, as after an operator.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def code_only(source: str) -> str:
    """``source`` with the insides of comments, strings, templates and regular expressions blanked; every place stays where it was.

    Quotes stay, and so does code inside of a template's ``${}``. A stack of brackets tells where such code ends.
    """
    out, at, last, stack = list(source), 0, "", []

    def blank(a: int, z: int) -> None:
        out[a:z] = [c if c == "\n" else " " for c in source[a:z]]

    def template(a: int) -> int:
        end = _TEMPLATE.match(source, a).end()
        blank(a, end)
        if source.startswith("${", end):
            stack.append("`")
            return end + 2
        return end + 1

    while m := _SCRIPT_TOKEN.search(source, at):
        token, at = m[0], m.end()
        if token[:2] in ("//", "/*"):
            blank(m.start(), at)
            continue
        if token[0] in "\"'":
            blank(m.start() + 1, at - (len(token) > 1 and token[-1] == token[0]))
        elif token == "`":
            at = template(at)
        elif token == "/" and not (last and (last[-1].isalnum() or last[-1] in "_$)]\"'`}") and last not in _BEFORE_REGEX) and (r := _REGEX.match(source, m.start())):
            blank(m.start() + 1, r.end())
            at = r.end()
        elif token == "{":
            stack.append("{")
        elif token == "}" and stack and stack.pop() == "`":
            at = template(at)
        last = token
    return "".join(out)


_CLOSES = {")": "(", "]": "[", "}": "{"}


def _end(code: str, at: int) -> int:
    """The place behind the bracket that closes the first one opened from ``at`` on; the end of the code where none does."""
    depth = 0
    for m in re.finditer(r"[()\[\]{}]", code[at:]):
        depth += -1 if m[0] in _CLOSES else 1
        if depth <= 0:
            return at + m.end()
    return len(code)


#: A quoted text in blanked code; its words are read from the source at the same place.
_Q = r"[\"'`][^\"'`]*[\"'`]"
_SCRIPT_SHAPES = (
    # kind, era, pattern with name, target and extends groups; fixed shapes of the three generations
    ("component", "era1", re.compile(r"(?P<name>[\w.$]+)\s*=\s*(?P<extends>[\w.$]+)\.extend\s*\(")),
    ("patch", "era2", re.compile(r"(?P<target>[\w.$]+)\.include\s*\(\s*\{")),
    ("module", "era2", re.compile(rf"\b[\w$]+\.define\s*\(\s*(?P<name>{_Q})")),
    ("import", "era2", re.compile(rf"(?:(?P<name>[\w$]+)\s*=\s*)?\brequire\s*\(\s*(?P<target>{_Q})\s*\)")),
    ("component", "era3", re.compile(r"\bclass\s+(?P<name>[\w$]+)\s+extends\s+(?P<extends>[\w.$]+)\s*\{")),
    ("patch", "era3", re.compile(rf"(?<![\w.$])patch\s*\(\s*(?P<target>[\w.$]+?)(?:\.prototype)?\s*,\s*(?:(?P<name>{_Q})\s*,)?")),
    ("patch", "era3", re.compile(rf"(?P<target>[\w$]+)\.patch\s*\(\s*(?P<name>{_Q})\s*,")),
    ("import", "era3", re.compile(rf"\bimport\s+(?:(?P<name>[\w$*{{}},\s]+?)\s+from\s+)?(?P<target>{_Q})")),
    ("registry", "era3", re.compile(rf"\bregistry\s*\.category\s*\(\s*(?P<target>{_Q})\s*\)\s*\.add\s*\(\s*(?P<name>{_Q})\s*,\s*(?P<extends>[\w.$]+)?")),
)
_MODEL_READ = re.compile(rf"\borm\s*\.\s*(?:read|readGroup|searchRead|search_read)\s*\(\s*(?P<a>{_Q})|\b(?:resModel|model)\s*:\s*(?P<b>{_Q})")


def script_rows(source: str | None) -> list[dict]:
    """Components, patches, modules, imports and registry entries, each with its source up to the bracket that closes it.

    Shapes count in code alone, never in comments, strings, templates or regular expressions.
    """
    source = source or ""
    code = code_only(source)
    found = sorted(((m.start(), kind, era, m) for kind, era, shape in _SCRIPT_SHAPES for m in shape.finditer(code)), key=lambda x: (x[0], x[1], x[2]))
    out = []
    for at, kind, era, m in found:
        def word(group: str) -> str | None:
            if group not in m.re.groupindex or m[group] is None:  # noqa: B023
                return None
            return " ".join(source[m.start(group) : m.end(group)].split()).strip("\"'`")  # noqa: B023

        braced = m.end() - 1 if m[0].endswith(("{", "(")) else at
        end = m.end() if kind == "import" else _end(code, braced)
        inside = code[at:end]
        quoted = lambda r, *groups: next((source[at + r.start(g) + 1 : at + r.end(g) - 1] for g in groups if r[g] is not None), None)  # noqa: B023, E731
        template = re.search(rf"\bstatic\s+template\s*=\s*(?P<a>{_Q})|\btemplate\s*:\s*(?P<b>{_Q})", inside) if kind == "component" else None
        bound = _MODEL_READ.search(inside) if kind == "component" else None
        out.append({"kind": kind, "era": era, "name": word("name"), "target": word("target"), "extends": word("extends"), "template": quoted(template, "a", "b") if template else None,
            "bound_model": quoted(bound, "a", "b") if bound else None, "content": source[at:end].strip()})
    return out or ([{"kind": "chunk", "era": None, "content": source}] if source.strip() else [])


def scripts(files: DataFrame) -> DataFrame:
    return _each(files, SCRIPT, script_rows)


def suite_rows(source: str | None) -> list[dict]:
    s = source or ""
    framework = "hoot" if re.search(r"[\"']@[\w.-]+/hoot", s) else "qunit" if "QUnit." in s else "tour" if re.search(
        r"registry\.category\(\s*[\"']web_tour", s) else "unknown"
    strings = lambda head: re.findall(head + r"\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", s)
    return [{"framework": framework, "describe_blocks": strings(r"\b(?:describe|QUnit\.module)"), "test_names": strings(r"\b(?:test|QUnit\.test)"),
        "tags": strings(r"\.tags"), "mounts": sorted(set(re.findall(r"\bmount(?:View|WithCleanup)?\s*\(\s*([A-Z]\w*)", s)))}] if s.strip() else []


def script_tests(files: DataFrame) -> DataFrame:
    return _each(files, SUITE, suite_rows)


_BLOCK_COMMENT = r"/\*.*?(?:\*/|\Z)"
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: Comments of CSS, and of languages that have line comments as well (an address's ``//`` begins none).
_QUIET = {False: re.compile(f"{_BLOCK_COMMENT}|{_STRING}", re.S), True: re.compile(rf"{_BLOCK_COMMENT}|{_STRING}|(?<![:\w])//[^\n]*", re.S)}


def _rules(source: str, line_comments: bool) -> Iterator[tuple[str, str]]:
    """(head, whole) of top-level statements and braced rules, comments left out; braces in strings don't count."""
    text = _QUIET[line_comments].sub(lambda m: m[0] if m[0][0] in "\"'" else " ", source)
    shape = re.sub(_STRING, lambda m: "x" * len(m[0]), text)
    depth = at = 0
    head_end = None
    for m in re.finditer("[{};]", shape):
        i, c = m.start(), m[0]
        if c == "{":
            depth += 1
            head_end = i if depth == 1 else head_end
        elif c == "}":
            depth = max(0, depth - 1)
            if depth == 0 and head_end is not None:
                yield text[at:head_end].strip(), text[at : i + 1].strip()
                at, head_end = i + 1, None
        elif depth == 0:
            if whole := text[at : i + 1].strip():
                yield whole, whole
            at = i + 1


def style_rows(source: str | None, language: str) -> list[dict]:
    out = []
    for k, (head, whole) in enumerate(_rules(source or "", language != "css")):
        if re.match(r"@(?:import|use|forward)\b", head):
            found = re.search(r"[\"']([^\"']+)[\"']", head)
            kind, name = "import", found[1] if found else head
        elif m := re.match(r"@mixin\s+([\w-]+)", head) if language == "scss" else re.match(r"\.([\w-]+)\s*\(", head) if language == "less" else None:
            kind, name = "mixin", m[1]
        elif m := re.match(r"(?:\$|@|--)([\w-]+)\s*:", head):
            kind, name = "variable", m[1]
        elif head.startswith("@media"):
            kind, name = "media", head
        elif m := re.match(r"@extend\s+([^;]+)", head):
            kind, name = "extend", m[1].strip()
        else:
            kind, name = ("selector", head) if "{" in whole else ("raw", head)
        out.append({"language": language, "kind": kind, "name": name, "chunk_idx": k, "content": whole})
    return out


def styles(files: DataFrame, language: str) -> DataFrame:
    """Chunks by rule of CSS, SCSS or LESS files."""
    return _each(files, STYLE, lambda c: style_rows(c, language))


def style_imports(chunks: DataFrame) -> DataFrame:
    """Stylesheet -> stylesheet edges; only targets that are indexed, found by the end of their path."""
    from pyspark.sql import functions as F

    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("name", "/"), -1), "^_", ""), r"\.(css|scss|less)$", "")
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "^_", ""), r"\.(css|scss|less)$", "")
    files = chunks.select(F.col("path").alias("dst"), "module", stem.alias("stem")).distinct()
    wanted = chunks.filter("kind = 'import'").select(F.col("path").alias("src"), "module", name.alias("stem")).distinct()
    return wanted.join(files, ["module", "stem"]).filter("src <> dst").select("src", "dst").distinct()


def style_counts(chunks: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    count = lambda k: F.count_if(F.col("kind") == k)
    return chunks.groupBy("path", "module", "version", "language").agg(count("selector").alias("selectors"), count("variable").alias("variables"),
        count("import").alias("imports"), count("mixin").alias("mixins"))


def language_of(path: str) -> str:
    return PurePosixPath(path).suffix.lstrip(".")
