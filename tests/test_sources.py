"""Parsers on small sources."""

from __future__ import annotations

from codeloom.sources import markup, python_code, repos, spec

FILE = "path string, module string, version string, content string"
MODEL = '''
from framework import api, fields, models
class Order(models.Model):
    _name = "sale.order"
    _inherit = ["mail.thread"]
    _inherits = {"res.partner": "partner_id"}
    name = fields.Char("Reference", required=True)
    line_ids = fields.One2many("sale.line", "order_id")
    total = fields.Float(compute="_compute_total", readonly=False)
    @api.depends("line_ids.price", "name")
    def _compute_total(self):
        for o in self:
            o.total = self.name
    def write(self, vals):
        return super().write(vals)
class Ext(models.Model):
    _inherit = "sale.order"
'''
OLD = """
class old(osv.osv):
    _name = 'old.model'
    _columns = {
        'partner': fields.many2one('res.partner', 'P'),
        'n': fields.integer('N'),
    }
    _inherits = {'res.partner': 'partner'}
    def go(self, cr):
        print 'x'  # super(
    def write(self, cr):
        return super(old, self).write(cr)
"""


def test_python_models(spark):
    d = spark.createDataFrame([("a.py", "sale", "17.0", MODEL), ("b.py", "old", "8.0", OLD), ("c.py", "x", "17.0", None)], FILE)
    got = {(r.model, r.kind, r.name): r for r in python_code.members(d).collect()}
    assert got["sale.order", "field", "line_ids"].comodel == "sale.line" and got["sale.order", "field", "name"].required and got["sale.order", "field", "name"].label == "Reference"
    assert got["sale.order", "method", "_compute_total"].depends == ["line_ids.price", "name"] and got["sale.order", "method", "write"].has_super
    assert got["sale.order", "field", "total"].readonly is False and got["sale.order", "field", "name"].readonly is None
    assert got["old.model", "field", "partner"].comodel == "res.partner" and got["old.model", "method", "go"].line == 9
    assert got["old.model", "method", "write"].has_super and not got["old.model", "method", "go"].has_super
    edges = {(r.model, r.kind, r.dst, r.via_field) for r in python_code.inherit_edges(python_code.members(d)).collect()}
    assert edges == {("sale.order", "INHERITS", "mail.thread", None), ("sale.order", "DELEGATES_TO", "res.partner", "partner_id"), ("old.model", "DELEGATES_TO", "res.partner", "partner")}


def test_python_tests(spark):
    src = '@tagged("post_install", "-at_install")\nclass TestSale(TransactionCase):\n    def test_a(self):\n        o = self.env["sale.order"].create({})\n        self.assertEqual(o.state, 1)\n    def helper(self):\n        pass\n'
    r = python_code.tests(spark.createDataFrame([("t.py", "sale", "17.0", src)], FILE)).first()
    assert (r.test_class, r.name, r.asserts, r.via, r.model_refs, r.tagged) == ("TestSale", "test_a", 1, "assert", ["sale.order"], ["post_install", "-at_install"]) and "create" in r.method_refs and "state" in r.field_refs


def test_xml(spark):
    src = '<data><record id="v1" model="ir.ui.view"><field name="name">n</field><field name="model">sale.order</field><field name="inherit_id" ref="base.v"/><field name="arch" type="xml"><xpath expr="//field" position="after"><field name="x" invisible="a == 1"/></xpath></field></record><template id="t1" inherit_id="web.layout"><p/></template><report id="r1" string="R" model="sale.order" name="sale.doc" report_type="qweb-pdf"/></data>'
    got = {r.xmlid: r for r in markup.views(spark.createDataFrame([("v.xml", "sale", "17.0", src), ("bad.xml", "sale", "17.0", "<a>"), ("n.xml", "sale", "17.0", None)], FILE)).collect()}
    assert set(got) == {"sale.v1", "sale.t1", "sale.r1"}
    assert got["sale.v1"].mode == "extension" and got["sale.v1"].xpaths[0].position == "after" and got["sale.v1"].conditions[0].field == "x"
    assert got["sale.t1"].inherit_xmlid == "web.layout" and got["sale.r1"].report_name == "sale.doc"


def test_scripts_and_styles(spark):
    js = 'class Card extends Component { static template = "my.Card"; }\npatch(ListView.prototype, "fix", {});\nvar W = Widget.extend({});\nForm.include({x: 1});'
    got = [(r.kind, r.era, r.name, r.target, r.template) for r in markup.scripts(spark.createDataFrame([("a.js", "web", "17.0", js)], FILE)).collect()]
    assert got == [("component", "era3", "Card", None, "my.Card"), ("patch", "era3", "fix", "ListView", None), ("component", "era1", "W", None, None), ("patch", "era2", None, "Form", None)]
    scss = "@import 'vars';\n$primary: red;\n@mixin box($a) { x: $a; }\n.o_form { .b { c: d; } }\n@media print { .p { q: r; } }"
    rows = markup.styles(spark.createDataFrame([("s/main.scss", "web", "17.0", scss), ("s/_vars.scss", "web", "17.0", "$a: 1;")], FILE), "scss")
    assert [(r.kind, r.name) for r in rows.filter("path = 's/main.scss'").orderBy("chunk_idx").collect()] == [("import", "vars"), ("variable", "primary"), ("mixin", "box"), ("selector", ".o_form"), ("media", "@media print")]
    assert [tuple(r) for r in markup.style_imports(rows).collect()] == [("s/main.scss", "s/_vars.scss")]
    assert {r.path: (r.selectors, r.mixins) for r in markup.style_counts(rows).collect()}["s/main.scss"] == (1, 1)
    suite = markup.suite_rows('import { test } from "@web/hoot";\ndescribe("list", () => { test("opens", () => mountView(ListView)); });')[0]
    assert (suite["framework"], suite["describe_blocks"], suite["test_names"], suite["mounts"]) == ("hoot", ["list"], ["opens"], ["ListView"])


def test_manifests(spark, tmp_path):
    for name, files in {"sale": {"__manifest__.py": "{'name': 'Sales', 'version': '17.0.1.2', 'depends': ['base', 'mail'], 'license': 'LGPL-3', 'assets': {'web.a': ['x.js', ('include', 'web.b')]}}", "__openerp__.py": "{}"}, "ent": {"__manifest__.py": "{'name': 'E', 'license': 'OEEL-1'}"}, "odd": {"__openerp__.py": "{'name': 'Odd', 'version': VERSION, 'depends': ['base']}"}, "off": {"__manifest__.py": "{'installable': False}"}}.items():
        (tmp_path / name).mkdir()
        for f, text in files.items():
            (tmp_path / name / f).write_text(text)
    rows = repos.module_rows(repos.find_manifests(spark, str(tmp_path)))
    got = {r.name: r for r in repos.registry(rows, "16.0").collect()}
    assert set(got) == {"sale", "odd"} and got["sale"].version == "17.0" and got["odd"].version == "16.0" and got["odd"].depends == ["base"]
    a = repos.asset_contributions(rows.filter("name = 'sale'")).first()
    assert (a.bundle, a.includes) == ("web.a", ["web.b"])
    assert sorted((r.src, r.dst) for r in repos.dependency_edges(repos.registry(rows, "16.0")).collect()) == [("odd", "base"), ("sale", "base"), ("sale", "mail")]


def test_spec(spark):
    src = "class Env:\n    def ref(self, x): pass\n    def _hidden(self): pass\ndef old():\n    warnings.warn('x', DeprecationWarning)\n"
    got = {r.qualified_name: (r.kind, r.status) for r in spec.symbols(spark.createDataFrame([("m.py", "core", "17.0", src)], FILE)).collect()}
    assert got == {"Env": ("class", "stable"), "Env.ref": ("method", "stable"), "old": ("function", "deprecated")}
    cli = "class Shell:\n    def run(self):\n        p.add_argument('-i', '--interface', default='ipython', help='h')\n"
    assert [(r["command"], r["flag"], r["default"]) for r in spec.flag_rows(cli)] == [("shell", "--interface", "'ipython'")]
    lines = spark.createDataFrame([("a.py", 1, "cr.commit()"), ("a.py", 2, "cr.commit()  # noqa: E8102"), ("a.py", 3, "x")], "path string, line int, text string")
    rules = spark.createDataFrame([("E8102", r"cr\.commit\(\)")], "rule_id string, code_pattern string")
    assert [tuple(r) for r in spec.check_lines(lines, rules).collect()] == [("a.py", 1, "E8102", "pattern")]


def test_lint_falls_back_to_words(spark):
    lines = spark.createDataFrame([("a.py", 1, "x = translation_of(y)"), ("a.py", 2, "the translation method"), ("b.py", 1, "first"), ("b.py", 2, "translation"), ("b.py", 3, "method"), ("c.py", 1, "translation method # noqa: W1"), ("d.py", 1, "z" * 5000)], "path string, line int, text string")
    rules = spark.createDataFrame([("W1", "(unclosed", "avoid the translation method"), ("W2", None, "translation"), ("W3", "z+", "zz")], "rule_id string, code_pattern string, message string")
    assert sorted(tuple(r) for r in spec.check_lines(lines, rules).collect()) == [("a.py", 2, "W1", "fuzzy"), ("b.py", 1, "W1", "fuzzy")]


def test_editions(spark):
    rows = [("vx_sale", None, "X", "/a/addons/vx_sale"), ("sale", "OEEL-1", None, "/x"), ("l10n", "OPL-1", "Vendor Co", "/x"), ("l10n", "OPL-1", "Other", "/x"), ("crm", "LGPL-3", None, "/src/addons/crm"), ("crm", "AGPL-3", None, "/src/crm"), ("web", "Assoc-1", None, "/x")]
    d = spark.createDataFrame(rows, "name string, license string, author string, path string")
    got = d.select(repos.edition(*(d[c] for c in d.columns), prefixes=["vx_"], authors=["Vendor"], association="assoc"))
    assert [r[0] for r in got.collect()] == ["vendor", "enterprise", "vendor", "custom", "community", "custom", "association"]


def test_uses_follow_definitions():
    src = """
class T(TransactionCase):
    @classmethod
    def setUpClass(cls):
        cls.order = cls.env["sale.order"].create({})
        cls.other = make()

    def test_a(self):
        order, n = self.order, 1
        mine = self.order.with_user(u).sudo()
        self.assertEqual(mine.state, self.order.total)
        if n:
            mine = self.other
        mine.gone
        for line in self.env["sale.line"].search([]):
            line.price
        (a, mine) = pair()
        self.order._private
        self.order.line_ids.qty

    def tearDown(self):
        self.order.unlink()
"""
    got = [(r["test"], r["model"], r["name"], r["called"], r["asserted"], r["via"]) for r in python_code.use_rows(src)]
    a = ("test_a", "sale.order")
    assert set(got) == {("setUpClass", "sale.order", "create", True, False, "setup"), (*a, "with_user", True, False, "assert"), (*a, "sudo", True, False, "assert"), (*a, "state", False, True, "assert"),
        (*a, "total", False, True, "assert"), ("test_a", "sale.line", "search", True, False, "assert"), ("test_a", "sale.line", "price", False, False, "assert"), (*a, "line_ids", False, False, "assert"),
        ("tearDown", "sale.order", "unlink", True, False, "setup")} and len(got) == len(set(got))
    assert {g[2] for g in got} == {"create", "with_user", "sudo", "state", "total", "search", "price", "line_ids", "unlink"}
    assert python_code.use_rows("class T(:") == [] and python_code.use_rows(None) == []


def test_code_only():
    same = lambda s: markup.code_only(s)
    assert same("a // b\nc") == "a     \nc" and same("a /* b") == "a     " and same("'a\\'b' + c") == "'    ' + c"
    assert same("x = a / b / c; y = /[/'\"]+/g.test(s)") == "x = a / b / c; y = /        .test(s)"
    assert same("`a ${b + `c ${d} e` + '}'} f` g") == "`  ${b + `  ${d}  ` + ' '}  ` g"
    assert same("return /'/ ; s") == "return /   ; s" and same("f(/{/) }") == "f(/  ) }"
    assert same("'open\nnext") == "'    \nnext"
    for s in ("`${", "`", "'", "/", "}", "${}", "\\", "a`b${c}d`e}"):
        assert len(same(s)) == len(s)


def test_script_content_ends_at_its_bracket():
    src = 'class A extends B { x = "}"; }\nclass C extends D { /* { */ }\nvar W = A.extend({ a: [1, (2)] }); tail();\nrequire("x.y")'
    got = [(r["kind"], r["name"], r["target"], r["content"]) for r in markup.script_rows(src)]
    assert got == [("component", "A", None, 'class A extends B { x = "}"; }'), ("component", "C", None, "class C extends D { /* { */ }"), ("component", "W", None, "W = A.extend({ a: [1, (2)] })"), ("import", None, "x.y", 'require("x.y")')]
    assert markup.script_rows("// class A extends B {") == [{"kind": "chunk", "era": None, "content": "// class A extends B {"}] and markup.script_rows(None) == []
    assert [(r["kind"], r["target"], r["name"]) for r in markup.script_rows('import "@a/b";\nimport X, { y as z } from \'@c/d\';')] == [("import", "@a/b", None), ("import", "@c/d", "X, { y as z }")]


def test_parsing_is_dealt_over_tasks(spark):
    """Files of one split are parsed by many tasks, and edges parse them once."""
    d = spark.createDataFrame([(f"p{i}.py", "m", "17.0", f"class A:\n    _name = 'a{i}'\n    _inherit = ['b', 'c']\n") for i in range(40)],
        "path string, module string, version string, content string").coalesce(1)
    assert python_code.members(d).rdd.getNumPartitions() > 1 and markup.views(d).rdd.getNumPartitions() > 1
    edges = python_code.inherit_edges(python_code.members(d))
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and edges.count() == 80
