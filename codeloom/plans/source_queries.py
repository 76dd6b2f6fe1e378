"""Parsers bound to source files that are made from the test tables' rows, so that SQL knows what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import markup, python_code, repos, spec
from .registry import Tables, query

def key() -> Column:
    return F.col("p_partkey")


def filled(template: str, *values: Column) -> Column:
    """``template`` with its ``%s`` filled in; the templates hold no other percent signs."""
    return F.format_string(template, *values)


def files(rows: DataFrame, path: Column, module: Column, content: Column) -> DataFrame:
    return rows.select(path.alias("path"), module.alias("module"), F.lit("17.0").alias("version"), content.alias("content"))


_MANIFEST = """{
    'name': 'S %s', 'version': '%s', 'license': %s,
    'depends': ['base', 'm%s'], 'author': ['A', 'B'], 'category': 'Sales/%s', 'auto_install': %s, 'installable': %s,
    'assets': {'web.bundle': ['a%s.js', ('include', 'web.other')]},
}"""


def _manifests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    text = filled(
        _MANIFEST, k, F.when(k % 3 == 0, "1.0").otherwise(F.concat(F.lit("1"), k % 4 + 4, F.lit(".0.1.0"))),
            F.when(k % 5 == 0, "None").when(k % 5 == 1, "'OEEL-1'").otherwise("'LGPL-3'"), F.expr("s_suppkey div 2"),
        F.col("s_nationkey"), F.when(k % 2 == 0, "True").otherwise("False"), F.when(k % 7 == 0, "False").otherwise("True"), k,
    )
    broken = F.when(k % 11 == 0, F.regexp_replace(text, "'category'", "category")).when(k % 13 == 0, "[1, 2").otherwise(text)
    return t.supplier.select(F.concat(F.lit("/r/addons/s"), k, F.lit("/__manifest__.py")).alias("path"), broken.alias("content"))


_REG = """m AS (SELECT s_suppkey AS k, 's' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN '16.0' ELSE '1' || (s_suppkey % 4 + 4) || '.0' END AS version,
  CASE s_suppkey % 5 WHEN 0 THEN 'LGPL-3' WHEN 1 THEN 'OEEL-1' ELSE 'LGPL-3' END AS license, s_nationkey, s_suppkey // 2 AS up FROM supplier
    WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 13 <> 0 OR s_suppkey % 11 = 0))"""


@query(f"SELECT WITHCTE FROM m".replace("SELECT WITHCTE",
    f"WITH {_REG} SELECT name, version, license, CASE WHEN k % 11 = 0 THEN NULL ELSE 'Sales/' || s_nationkey END AS category, CASE WHEN k % 11 = 0 THEN NULL ELSE 'A, B' END AS author, ['base', 'm' || up] AS depends, k % 2 = 0 AS auto_install") + " WHERE license <> 'OEEL-1'")
def module_registry(t: Tables) -> DataFrame:
    r = repos.registry(repos.module_rows(_manifests(t)), "16.0")
    return r.select("name", "version", "license", "category", "author", "depends", "auto_install")


@query(f"WITH {_REG} SELECT DISTINCT name AS src, unnest(['base', 'm' || up]) AS dst, version FROM m WHERE license <> 'OEEL-1'")
def manifest_edges(t: Tables) -> DataFrame:
    return repos.dependency_edges(repos.registry(repos.module_rows(_manifests(t)), "16.0"))


@query(f"""WITH {_REG} SELECT name AS module, 'web.bundle' AS bundle, '["a' || k || '.js", ["include", "web.other"]]' AS entries,
    ['web.other'] AS includes FROM m WHERE license <> 'OEEL-1' AND k % 11 <> 0""")
def asset_bundles(t: Tables) -> DataFrame:
    return repos.asset_contributions(repos.registry(repos.module_rows(_manifests(t)), "16.0"))


_MODEL = """
from framework import api, fields, models

class Part(models.Model):
    _name = "part.%s"
    _inherit = ["part.%s"]
    size = fields.Integer("Size", required=%s)
    up_id = fields.Many2one("part.%s", readonly=True)
    total = fields.Float(compute="_compute_total")

    @api.depends("up_id.size", "size")
    def _compute_total(self):
        for one in self:
            one.total = one.size

    def write(self, vals):
        %s
        return True
"""
_LEGACY = """
class part(osv.osv):
    _name = 'part.%s'
    _columns = {
        'size': fields.integer('Size'),
        'up_id': fields.many2one('part.%s', 'Up'),
    }
    def write(self, cr):
        print 'x'
        %s
"""


def _models(t: Tables) -> DataFrame:
    half = F.expr("p_partkey div 2")
    modern = filled(_MODEL, key(), half, F.when(key() % 2 == 0, "True").otherwise("False"), half,
        F.when(key() % 3 == 0, "super().write(vals)").otherwise("pass"))
    return files(t.part, F.concat(F.lit("models/p"), key(), F.lit(".py")), F.concat(F.lit("m"), key() % 9),
        F.when(key() % 10 == 0, filled(_LEGACY, key(), half, F.when(key() % 20 == 0, "return super(part, self).write(cr)").otherwise("return True  # no super() here"))).otherwise(modern))


@query("""WITH x AS (SELECT 'part.' || p_partkey AS model, 'part.' || (p_partkey // 2) AS up, 'm' || (p_partkey % 9) AS module, p_partkey AS k,
    p_partkey % 10 = 0 AS old FROM part)
  SELECT model, module, 'field' AS kind, 'size' AS name, 'integer' AS ttype, NULL AS comodel, NOT old AND k % 2 = 0 AS required FROM x UNION ALL
    SELECT model, module, 'field', 'up_id', 'many2one', up, false FROM x
  UNION ALL SELECT model, module, 'field', 'total', 'float', NULL, false FROM x WHERE NOT old""")
def parsed_fields(t: Tables) -> DataFrame:
    return python_code.members(_models(t)).filter("kind = 'field'").select("model", "module", "kind", "name", "ttype", "comodel",
        F.coalesce("required", F.lit(False)).alias("required"))


@query("""WITH x AS (SELECT 'part.' || p_partkey AS model, p_partkey AS k, p_partkey % 10 = 0 AS old FROM part)
  SELECT model, '_compute_total' AS name, ['up_id.size', 'size'] AS depends, false AS has_super FROM x WHERE NOT old UNION ALL SELECT model, 'write',
    [], k % 3 = 0 FROM x WHERE NOT old UNION ALL SELECT model, 'write', [], k % 20 = 0 FROM x WHERE old""")
def parsed_methods(t: Tables) -> DataFrame:
    m = python_code.members(_models(t)).filter("kind = 'method'")
    return m.select("model", "name", F.coalesce("depends", F.array().cast("array<string>")).alias("depends"),
        F.coalesce("has_super", F.lit(False)).alias("has_super"))


@query("SELECT 'part.' || p_partkey AS model, 'part.' || (p_partkey // 2) AS dst, 'INHERITS' AS kind FROM part WHERE p_partkey % 10 <> 0 AND p_partkey > 0")
def parsed_inherits(t: Tables) -> DataFrame:
    return python_code.inherit_edges(python_code.members(_models(t).filter("path <> 'models/p0.py'"))).select("model", "dst", "kind")


_SUITE = """
@tagged("post_install", "t%s")
class TestPart%s(TransactionCase):
    def test_total(self):
        part = self.env["part.%s"].create({})
        self.assertEqual(part.total, 1)
        %s

    def helper(self):
        pass
"""


@query("""SELECT 'TestPart' || p_partkey AS test_class, ['post_install', 't' || (p_partkey % 4)] AS tagged, ['TransactionCase'] AS bases,
    'test_total' AS name, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS asserts, ['part.' || p_partkey] AS model_refs FROM part""")
def parsed_tests(t: Tables) -> DataFrame:
    src = filled(_SUITE, key() % 4, key(), key(), F.when(key() % 2 == 0, "self.assertTrue(part)").otherwise("pass"))
    rows = python_code.tests(files(t.part, F.concat(F.lit("tests/t"), key(), F.lit(".py")), F.lit("m"), src))
    return rows.filter("name = 'test_total'").select("test_class", "tagged", "bases", "name", "asserts", "model_refs")


_USES = """
class TestPart%s(TransactionCase):
    def setUp(self):
        super().setUp()
        self.part = self.env["part.%s"].create({})

    def test_total(self):
        one = self.part
        self.assertEqual(one.total, 1)
        one.with_context(x=1).write({"size": 2})
        other = self.env["part.%s"].search([])
        for o in other:
            o.size
        one = None
        one.up_id
        unknown.total

    def helper(self):
        return self.part.sudo().size
"""


@query("""WITH x AS (SELECT p_partkey AS k, 'TestPart' || p_partkey AS c, 'part.' || p_partkey AS own, 'part.' || (p_partkey // 2) AS up FROM part WHERE p_partkey % 10 <> 0),
  u AS (SELECT c, 'test_total' AS test, own AS model, 'total' AS name, 'assert' AS via, true AS asserted FROM x UNION ALL SELECT c, 'test_total', own, 'write', 'assert', false FROM x
    UNION ALL SELECT c, 'test_total', up, 'size', 'assert', false FROM x UNION ALL SELECT c, 'helper', own, 'size', 'body', false FROM x)
  SELECT c AS test_class, test, model, name, 'm' || (p_partkey % 9) AS module, via, asserted FROM u JOIN part ON model = 'part.' || p_partkey WHERE name <> 'total' OR p_partkey % 10 <> 0""")
def test_coverage(t: Tables) -> DataFrame:
    """Edges from tests to members by def-use chains: a name that lost its record, or never had one, covers nothing."""
    text = filled(_USES, key(), key(), F.expr("p_partkey div 2"))
    src = files(t.part.filter("p_partkey % 10 <> 0"), F.concat(F.lit("tests/t"), key(), F.lit(".py")), F.lit("m"), text)
    return python_code.coverage(python_code.uses(src), python_code.members(_models(t)))


_VIEW = (
    '<data><record id="v%s" model="ir.ui.view"><field name="name">n</field><field name="model">part.%s</field>%s<field name="arch" type="xml"><%s><field name="size" invisible="a == %s"/></%s></field></record>'
    '<template id="t%s" inherit_id="web.layout"><p/></template><report id="r%s" string="R" model="part" name="part.doc" report_type="pdf"/></data>'
)


@query("""WITH x AS (SELECT p_partkey AS k, 'm' || (p_partkey % 9) AS m FROM part WHERE p_partkey % 12 <> 0)
  SELECT 'view' AS kind, m || '.v' || k AS xmlid, 'part.' || k AS model, CASE WHEN k % 3 = 0 THEN 'list' ELSE 'form' END AS view_type, CASE
    WHEN k % 2 = 0 THEN 'extension' ELSE 'primary' END AS mode, CASE WHEN k % 2 = 0 THEN m || '.base' END AS inherit_xmlid FROM x
  UNION ALL SELECT 'qweb', m || '.t' || k, NULL, NULL, 'extension', 'web.layout' FROM x UNION ALL SELECT 'report', m || '.r' || k, 'part', NULL, NULL,
    NULL FROM x""")
def parsed_views(t: Tables) -> DataFrame:
    tag = F.when(key() % 3 == 0, "list").otherwise("form")
    text = filled(_VIEW, key(), key(), F.when(key() % 2 == 0, '<field name="inherit_id" ref="base"/>').otherwise(""), tag, key(), tag, key(), key())
    v = markup.views(files(t.part, F.concat(F.lit("views/v"), key(), F.lit(".xml")), F.concat(F.lit("m"), key() % 9),
        F.when(key() % 12 == 0, "<data>").otherwise(text)))
    return v.select("kind", "xmlid", "model", "view_type", "mode", "inherit_xmlid")


_SCRIPT = """class Card%s extends Component { static template = "web.Card%s"; }
patch(View%s.prototype, "fix", {});
var Old%s = Widget.extend({});
Form%s.include({x: 1});"""


@query("""WITH x AS (SELECT s_suppkey AS k FROM supplier)
  SELECT 'component' AS kind, 'era3' AS era, 'Card' || k AS name, NULL AS target, 'web.Card' || k AS template FROM x UNION ALL SELECT 'patch', 'era3',
    'fix', 'View' || k, NULL FROM x
  UNION ALL SELECT 'component', 'era1', 'Old' || k, NULL, NULL FROM x UNION ALL SELECT 'patch', 'era2', NULL, 'Form' || k, NULL FROM x""")
def parsed_scripts(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return markup.scripts(files(t.supplier, F.concat(F.lit("s"), k, F.lit(".js")), F.lit("web"), filled(_SCRIPT, k, k, k, k, k))).select("kind",
        "era", "name", "target", "template")


_TRICKY = """/** @web-module **/
import { Component, useState } from "@web/core%s";
// class Ghost%s extends Component {}
const text = "patch(Ghost.prototype, 'x', {})", re = /class Ghost extends Component {"/g;
const tpl = `class Ghost extends Component { ${new (class Inner%s extends Component { })} }`;
export class Card%s extends owl.Component {
    static template = "web.Card%s"; /* static template = "no" */
    async load() { return this.orm.searchRead("part.%s", [["a", "=", "}"]]); }
}
registry.category("fields").add("card%s", Card%s);
Card%s.patch("web.fix", T => class extends T { });
boot.define("web.old%s", function (require) { var W = require("web.Widget"); });"""


@query("""WITH x AS (SELECT s_suppkey AS k FROM supplier), r AS (
  SELECT k, 'import' AS kind, '{ Component, useState }' AS name, '@web/core' || k AS target, NULL AS extends, NULL AS template, NULL AS bound_model FROM x
  UNION ALL SELECT k, 'component', 'Inner' || k, NULL, 'Component', NULL, NULL FROM x UNION ALL SELECT k, 'component', 'Card' || k, NULL, 'owl.Component', 'web.Card' || k, 'part.' || k FROM x
  UNION ALL SELECT k, 'registry', 'card' || k, 'fields', 'Card' || k, NULL, NULL FROM x UNION ALL SELECT k, 'patch', 'web.fix', 'Card' || k, NULL, NULL, NULL FROM x
  UNION ALL SELECT k, 'module', 'web.old' || k, NULL, NULL, NULL, NULL FROM x UNION ALL SELECT k, 'import', 'W', 'web.Widget', NULL, NULL, NULL FROM x)
  SELECT 's' || k || '.js' AS path, kind, name, target, extends, template, bound_model FROM r""")
def script_graph(t: Tables) -> DataFrame:
    """Imports, classes, registry entries and patches of code alone: shapes in comments, strings, templates and regular expressions are none."""
    k = F.col("s_suppkey")
    rows = markup.scripts(files(t.supplier, F.concat(F.lit("s"), k, F.lit(".js")), F.lit("web"), filled(_TRICKY, *[k] * 10)))
    return rows.select("path", "kind", "name", "target", "extends", "template", "bound_model")


@query("""SELECT 's' || s_suppkey || '.js' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'hoot' ELSE 'qunit' END AS framework,
    ['list ' || s_suppkey] AS describe_blocks, CASE WHEN s_suppkey % 2 = 0 THEN ['opens', 'closes'] ELSE ['opens'] END AS test_names FROM supplier""")
def parsed_script_tests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    hoot = filled('import { test } from "@web/hoot";\ndescribe("list %s", () => { test("opens", () => 1); test("closes", () => 2); });', k)
    old = filled('QUnit.module("list %s", {}, function () { QUnit.test("opens", f); });', k)
    rows = markup.script_tests(files(t.supplier, F.concat(F.lit("s"), k, F.lit(".js")), F.lit("web"), F.when(k % 2 == 0, hoot).otherwise(old)))
    return rows.select("path", "framework", "describe_blocks", "test_names")


_SHEET = """/* head { } */
@import 's%s';
// a line { with braces
$primary%s: red;
@mixin box%s($a) { x: $a; }
.o_form%s { .b { c: "}"; } }
@media print { .p { q: r; } }"""


def _sheets(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return markup.styles(files(t.supplier, F.concat(F.lit("scss/_s"), k, F.lit(".scss")), F.lit("web"),
        filled(_SHEET, F.expr("s_suppkey div 2"), k, k, k)), "scss")


@query("""WITH x AS (SELECT s_suppkey AS k, 'scss/_s' || s_suppkey || '.scss' AS path FROM supplier)
  SELECT path, 0 AS chunk_idx, 'import' AS kind, 's' || (k // 2) AS name FROM x UNION ALL SELECT path, 1, 'variable', 'primary' || k FROM x UNION ALL
    SELECT path, 2, 'mixin', 'box' || k FROM x
  UNION ALL SELECT path, 3, 'selector', '.o_form' || k FROM x UNION ALL SELECT path, 4, 'media', '@media print' FROM x""")
def parsed_styles(t: Tables) -> DataFrame:
    return _sheets(t).select("path", "chunk_idx", "kind", "name")


@query("""SELECT 'scss/_s' || a.s_suppkey || '.scss' AS src, 'scss/_s' || b.s_suppkey || '.scss' AS dst FROM supplier a
    JOIN supplier b ON a.s_suppkey // 2 = b.s_suppkey AND a.s_suppkey <> b.s_suppkey""")
def style_imports(t: Tables) -> DataFrame:
    return markup.style_imports(_sheets(t))


@query("SELECT 'scss/_s' || s_suppkey || '.scss' AS path, 1::BIGINT AS selectors, 1::BIGINT AS variables, 1::BIGINT AS imports, 1::BIGINT AS mixins FROM supplier")
def style_counts(t: Tables) -> DataFrame:
    return markup.style_counts(_sheets(t)).select("path", "selectors", "variables", "imports", "mixins")


_CORE = """import warnings

class Env%s:
    def ref(self, xmlid, raise_if=True):
        pass

    def _hidden(self):
        pass

def old%s(a):
    warnings.warn("x", DeprecationWarning)
"""


@query("""WITH x AS (SELECT n_nationkey AS k FROM nation) SELECT 'Env' || k AS qualified_name, 'class' AS kind, NULL AS signature, 'stable' AS status FROM x
  UNION ALL SELECT 'Env' || k || '.ref', 'method', 'self, xmlid, raise_if=True', 'stable' FROM x UNION ALL SELECT 'old' || k, 'function', 'a',
    'deprecated' FROM x""")
def core_symbols(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return spec.symbols(files(t.nation, F.concat(F.lit("c"), k, F.lit(".py")), F.lit("core"), filled(_CORE, k, k))).select("qualified_name", "kind",
        "signature", "status")


@query("""WITH x AS (SELECT n_nationkey AS k FROM nation) SELECT 'shell' AS command, '--interface' || k AS flag, '''ipython''' AS "default",
    'h' AS help FROM x UNION ALL SELECT 'server', '--port' || k, CAST(8000 + k AS VARCHAR), NULL FROM x""")
def cli_flags(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    text = filled("class Shell:\n    def run(self):\n        p.add_argument('-i', '--interface%s', default='ipython', help='h')\ngroup.add_option('--port%s', my_default=%s)\n", k, k, k + 8000)
    return spec.flags(files(t.nation, F.concat(F.lit("c"), k, F.lit(".py")), F.lit("core"), text)).select("command", "flag", "default", "help")


@query("SELECT n_name AS qualified_name, 'v' AS version, CASE WHEN n_nationkey % 2 = 0 THEN 'parsed' ELSE 'curated' END AS status FROM nation")
def curated_symbols(t: Tables) -> DataFrame:
    row = lambda d, status: d.select(F.col("n_name").alias("qualified_name"), F.lit("v").alias("version"), F.lit(status).alias("status"))
    return spec.prefer_parsed(row(t.nation.filter("n_nationkey % 2 = 0"), "parsed"), row(t.nation, "curated"))
