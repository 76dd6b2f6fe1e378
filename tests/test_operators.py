"""Hand-built graphs and small cases for the operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import scalars, text
from codeloom.operators import aggregates, control, diff, graph, lineage, ranking, scope, search, store, tools, validate
from codeloom.streaming import events

EDGE = "src string, dst string, kind string, via_field string"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_nearest_owner_wins_and_delegation_carries_no_methods(spark):
    e = spark.createDataFrame([("child", "mixin", "INHERITS", None), ("child", "parent", "DELEGATES_TO", "p_id"), ("mixin", "far", "INHERITS", None), ("child", "child", "INHERITS", None)], EDGE)
    s = spark.createDataFrame([("child",)], "start string")
    tags = graph.ancestors(s, e)
    assert rows(tags, "name", "depth", "via_field") == [("child", 0, None), ("far", 2, None), ("mixin", 1, None), ("parent", 1, "p_id")]
    m = spark.createDataFrame([("mixin", "x", "m1", "community", "char"), ("child", "x", "m9", "association", "date"), ("far", "y", "m1", "association", "int"), ("parent", "z", "m1", "association", "int")], "model string, name string, module string, edition string, ttype string")
    got = ranking.inherited_members(tags, m)
    assert rows(got, "name", "owner", "ttype") == [("x", "child", "date"), ("y", "far", "int"), ("z", "parent", "int")]
    methods = graph.ancestors(s, e, kinds=("INHERITS",))
    assert "parent" not in {r.name for r in methods.collect()}
    # the module filter comes before the pick, so the farther owner wins
    assert rows(ranking.inherited_members(tags, m, "m1"), "name", "owner") == [("x", "mixin"), ("y", "far"), ("z", "parent")]


def test_dense_mesh(spark):
    """80 extenders of one definition: names, not paths, are followed."""
    e = spark.createDataFrame([("ext", "base", "INHERITS", None)] * 80 + [("base", "near", "INHERITS", None), ("near", "far", "INHERITS", None)], EDGE)
    tags = graph.ancestors(spark.createDataFrame([("ext",)], "start string"), e)
    assert rows(tags, "name", "depth") == [("base", 1), ("ext", 0), ("far", 3), ("near", 2)]


def test_subtype(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "INHERITS", None) for i in range(8)], EDGE)
    p = spark.createDataFrame([("n0", "n0"), ("n0", "n5"), ("n0", "n6"), ("n3", "n1")], "comodel string, target string")
    assert rows(graph.is_subtype(p, e), "comodel", "target", "ok") == [("n0", "n0", True), ("n0", "n5", True), ("n0", "n6", False), ("n3", "n1", False)]


def test_closure_with_cycle_diamond_and_missing(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "ghost")], "src string, dst string")
    got = graph.closure(spark.createDataFrame([("a",)], "root string"), e)
    assert rows(got, "name", "depth") == [("b", 1), ("c", 1), ("d", 2), ("ghost", 3)]


def test_paths(spark):
    m = spark.createDataFrame([("o", "partner", "many2one", "p"), ("p", "name", "char", None), ("o", "loose", "many2one", None)], "model string, name string, ttype string, comodel string")
    cases = {"partner.name": "ok", "partner": "ok", "partner.nope": "missing", "loose.name": "dangling_comodel", "partner.name.x": "not_relational", "..": "missing", "loose": "ok"}
    got = graph.walk_paths(spark.createDataFrame([("o", p) for p in cases], "model string, path string"), m)
    assert {r.path: r.status for r in got.collect()} == cases


def test_topological_order():
    assert graph.topological_order(["c", "a", "b", "x", "y"], {"a": ["b", "missing"], "b": ["c"], "x": ["y"], "y": ["x"]}) == ["c", "b", "a", "x", "y"]
    assert graph.topological_order([], {}) == []


def test_levels_match_order(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcxy"], "name string")
    assert rows(graph.levels(e, n), "name", "level") == [("a", 2), ("b", 1), ("c", 0)]


def test_scope(spark):
    d = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, []), (4, None), (5, ["s"])], "id int, p array<string>")
    see = lambda *a: [r.id for r in d.filter(scope.visible(F.col("p"), *a)).orderBy("id").collect()]
    assert see(None) == [1, 2, 3, 4, 5] and see(["a"], ["s"]) == [1, 5] and see(["a", "b"], []) == [1, 2] and see([], []) == []
    assert scope.narrow(["a"], ["s"], "zz") == ([], []) and scope.narrow(["a", "b"], ["s"], "a") == (["a"], ["s"])


def test_symbol_diff(spark):
    kind = "name string, status string, replaced_by string"
    old = spark.createDataFrame([("gone", "active", None), ("moved", "active", "fresh"), ("dangling", "active", "nowhere"), ("aging", "active", None), ("was", "deprecated", None), ("same", None, None)], kind)
    new = spark.createDataFrame([("fresh", "active", None), ("aging", "deprecated", None), ("was", "deprecated", None), ("same", None, None)], kind)
    assert {r.name: r.bucket for r in diff.version_diff(old, new).collect()} == {"gone": "removed", "moved": "replaced", "dangling": "removed", "aging": "deprecated", "was": "stable", "same": "stable", "fresh": "added"}
    life = {r.name: (r.added_in, r.removed_in, r.deprecated_in) for r in diff.lifecycle(old, new, "16.0", "17.0").collect()}
    assert life["fresh"] == ("17.0", None, None) and life["gone"] == (None, "17.0", None) and life["aging"] == (None, None, "17.0")


def test_risk_thresholds(spark):
    d = spark.createDataFrame([(0,), (3,), (4,), (9,), (10,)], "n int").withColumn("r", scalars.risk_level(F.col("n")))
    assert [r.r for r in d.orderBy("n").collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_late_events(spark):
    t = lambda d: None if d is None else datetime(2024, 1, d)
    e = spark.createDataFrame([("k", 1, t(5), "a", None), ("k", 2, t(3), "stale", "seat"), ("k", 3, t(5), "equal", None), ("k", 4, None, "untimed", None), ("k", 5, t(4), "stale2", None)], "k string, n int, at timestamp, status string, extra string")
    r = events.late_guard(e, "k", "at", "n", ["status"], ["extra"]).first()
    assert (r.status, r.extra, r.at) == ("untimed", "seat", t(5))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), min_size=1, max_size=40))
def test_sliding_limit_is_the_plain_loop(spark, cases):
    base = datetime(2024, 1, 1)
    got = spark.createDataFrame([(k, i, base + timedelta(seconds=s)) for i, (k, s) in enumerate(cases)], "k int, i int, at timestamp")
    have = {r.i: r.allowed for r in events.sliding_limit(got, "k", "at", "i", 2, 5).collect()}
    held: dict[int, list[int]] = {}
    for i, (k, s) in sorted(enumerate(cases), key=lambda x: (x[1][1], x[0])):
        live = [x for x in held.get(k, []) if x >= s - 5]
        ok = len(live) < 2
        held[k] = live + [s] * ok
        assert have[i] == ok


def test_chunks_cover_the_text(spark):
    long = "".join(chr(97 + i % 26) for i in range(5000))
    d = spark.createDataFrame([(1, long), (2, "x" * 2048), (3, ""), (4, None)], "id int, text string")
    got = rows(text.chunks(d), "id", "chunk_idx", "content")
    assert [(i, k, len(c)) for i, k, c in got] == [(1, 0, 2048), (1, 1, 2048), (1, 2, 5000 - 2 * 1792), (2, 0, 2048)]
    small = rows(text.chunks(d.filter("id = 2"), budget=100), "chunk_idx", "content")
    assert "".join(c for _, c in small) == "x" * 2048 and max(len(c) for _, c in small) == 300


def test_style_literals(spark):
    yes = [".o_form", "#main", "$primary", "@brand", ".a .b", ".btn > .icon", "&:hover", "card__title", "o_list_view", "o-flex-center", "[data-x]", ".a my-name"]
    no = ["how to style a button", "button", "Red Button", "@media", "@IMPORT", ".a plain english words", ".", "$", "$a b", "", " ", "a.btn", "&:hover .x"]
    d = spark.createDataFrame([(x,) for x in [*yes, *no, None]], "q string").withColumn("lit", text.style_literal(F.col("q")))
    assert {r.q for r in d.collect() if r.lit} == set(yes)
    assert [r[0] for r in d.filter("q in ('$primary', '.o_form')").orderBy("q").select(text.literal_column(F.col("q"))).collect()] == ["content", "entity_name"]


def test_noqa_and_lint(spark):
    d = spark.createDataFrame([("x = 1  # noqa",), ("x = 1  # noqa: E501, W1",), ("x = 1",), ("x  # NOQA",)], "line string")
    got = [(r[0], r[1], r[2]) for r in d.select(text.suppressed(F.col("line"), F.lit("E501")), text.suppressed(F.col("line"), F.lit("F1")), text.suppressed(F.col("line"), F.lit("e501"))).collect()]
    assert got == [(True, True, True), (True, False, False), (False, False, False), (False, False, False)]
    d = spark.createDataFrame([("avoid translation method call", "translation of a method"), ("avoid translation", "translation")], "a string, b string")
    assert [r[0] for r in d.select(text.fuzzy_lint(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_conventions_readonly_and_domain_operators(spark):
    names = {"_search_x": ("search", "never", False), "_get_default_x": ("default", "never", False), "_get_x": ("builder", "usually", False), "name_get": ("public", "usually", False), "button_x": ("public", "usually", False), "write": ("crud", "always", True), "action_x": ("action", "always", True), "_x": ("private", "usually", False), "_check_x": ("check", "usually", False)}
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: tuple(r.c) for r in d.select("n", scalars.method_convention(F.col("n")).alias("c")).collect()} == names
    f = spark.createDataFrame([(None, None, None, None), (True, None, None, None), (False, "a.b", None, None), (None, "a.b", None, None), (None, None, "_c", None), (None, None, "_c", "_i"), (None, "a.b", None, "_i")], "r boolean, l string, c string, i string")
    assert [r[0] for r in f.select(scalars.effective_readonly(F.col("r"), F.col("l"), F.col("c"), F.col("i"))).collect()] == [False, True, False, True, True, False, False]
    o = spark.createDataFrame([("child_of", "8.0"), ("parent_of", "8.0"), ("parent_of", "9.0"), ("any", "16.0"), ("any", "17.0"), ("any!", "18.0"), ("not =like", "19.0"), ("any!", "master"), ("~", "19.0"), (None, "19.0")], "o string, v string")
    assert [r[0] for r in o.select(scalars.is_domain_operator(F.col("o"), F.col("v"))).collect()] == [True, False, True, False, True, False, True, True, False, False]
    a = spark.createDataFrame([(["one", "multi"],), (["x"],), (None,)], "d array<string>")
    assert [tuple(r) for r in a.select(scalars.any_of(F.col("d"), ["multi", "one"]), scalars.first_of(F.col("d"), ["multi", "one"])).collect()] == [(True, "one"), (False, None), (False, None)]


def test_chunk_headers(spark):
    rows = [("method", "sale", "17.0", "sale.order", "write", None), ("field", "sale", "17.0", "sale.order", "name", "char"), ("view", "sale", "17.0", None, "sale.v", "form, inherit=base.v"), ("qweb", "web", "17.0", None, "web.t", None), ("test_method", "sale", "17.0", "TestSale", "test_a", "sale.order.name"), ("test_class", "sale", "17.0", None, "TestSale", "Base"), ("js_era3", "web", "17.0", None, "Card", None)]
    d = spark.createDataFrame(rows, "kind string, module string, version string, owner string, name string, detail string")
    h = text.chunk_header(*(F.col(c) for c in d.columns))
    assert [r[0] for r in d.select(h).collect()] == ["[sale] sale.order.write (17.0)", "[sale] sale.order: name (char)", "[sale] sale.v (form, inherit=base.v)", "[web] web.t", "[test] sale.order.name via TestSale.test_a (17.0)", "[test class] TestSale(Base) in sale (17.0)", None]
    assert d.filter("kind = 'js_era3'").select(text.headed(F.col("kind"), h, F.lit("body"))).first()[0] == "body"


def test_like_escape_and_versions(spark):
    d = spark.createDataFrame([("50%_\\x",), ("50Z",)], "t string")
    assert d.filter(scalars.ilike_literal(F.col("t"), "50%_\\X")).count() == 1
    v = spark.createDataFrame([("9.0",), ("10.0",), ("saas~1",), (None,)], "v string")
    assert [r.v for r in v.orderBy(scalars.version_key(F.col("v")).desc_nulls_last(), "v").collect()][:2] == ["10.0", "9.0"]
    w = spark.createDataFrame([("12", "10", None), ("9", "10", None), ("x", "10", "11")], "v string, lo string, hi string")
    assert [r[0] for r in w.select(scalars.in_version_range(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == [True, False, True]


def test_store(spark):
    k = "name string, profile array<string>, is_definition boolean, note string"
    old = spark.createDataFrame([("a", ["x"], True, "n"), ("b", ["x"], False, None)], k)
    new = spark.createDataFrame([("a", ["y"], False, None), ("c", None, None, "z")], k)
    got = {r.name: (r.profile, r.is_definition, r.note) for r in store.upsert(old, new, ["name"], ["profile"], ["is_definition"]).collect()}
    assert got == {"a": (["x", "y"], True, "n"), "b": (["x"], False, None), "c": ([], False, "z")}
    chunks = "m string, i int, v array<float>"
    kept = store.keep_old_vectors(spark.createDataFrame([("m1", 0, [1.0]), ("m2", 0, [1.0])], chunks), spark.createDataFrame([("m1", 0, None), ("m2", 0, [2.0]), ("m2", 1, None)], chunks), ["m"], "v")
    assert rows(kept, "m", "i", "v") == [("m1", 0, [1.0]), ("m2", 0, [2.0])]


def test_control(spark):
    d = spark.createDataFrame([("17.0", "sale", 0, False), ("17.0", "sale", 1, True), ("17.0", "sale", 2, True), ("17.0", "crm", 0, False), ("17.0", "crm", 1, False)], "version string, module string, arrival int, long_format boolean")
    assert rows(control.registry_pick(d), "module", "arrival") == [("crm", 0), ("sale", 2)]
    v = spark.createDataFrame([("17.0.1.0", "x"), ("1.0", "16.0-dev"), (None, None)], "v string, b string")
    assert [r[0] for r in v.select(control.manifest_version(F.col("v"), F.col("b"))).collect()] == ["17.0", "16.0", "unknown"]


def test_search_keywords_agree(spark):
    q = "How to override the sale.order write method with super, sale.order. Größe naïve fields."
    d = spark.createDataFrame([(q,)], "q string")
    assert d.select(text.keywords(F.col("q"))).first()[0] == search.extract_keywords(q)


def test_quota_rounds_half_to_even(spark):
    used, plans = spark.createDataFrame([(1, 1)], "k int, used long"), spark.createDataFrame([(1, 80), (2, None), (3, 0)], "k int, quota long")
    assert rows(aggregates.quota(used, plans, "k"), "k", "remaining", "percent") == [(1, 79, 1.2), (2, None, None), (3, 0, None)]


def test_suggestions_are_the_standard_librarys(spark):
    from difflib import get_close_matches

    names = ["partner_id", "partner_ids", "amount_total", "amount_tax", "name", "state"]
    wrong = ["partner", "partnerid", "amount_totl", "nam", "zzz", "stat", "amount_t"]
    w = spark.createDataFrame([("m", x) for x in wrong] + [("other", "name")], "model string, name string")
    got = {(r.model, r.name): r.suggestion for r in validate.suggest(w, spark.createDataFrame([("m", n) for n in names], "model string, name string"), "model").collect()}
    assert got == {("m", x): (get_close_matches(x, names, n=1, cutoff=0.7) or [None])[0] for x in wrong} | {("other", "name"): None}


def test_deep_chains_have_no_cut(spark):
    parents = spark.createDataFrame([(i, i + 1 if i < 50 else None) for i in range(51)], "name int, parent int")
    changes = spark.createDataFrame([(50, 0), (0, 50)], "name int, new_parent int")
    assert rows(graph.would_cycle(changes, parents), "name", "cycle") == [(0, False), (50, True)]
    e = parents.filter("name >= 10 and parent is not null").select(F.col("name").alias("src"), F.col("parent").alias("dst"))
    root = spark.createDataFrame([(10,)], "root int")
    assert store.reachable_within(root, e, parents.select("name")).count() == 40
    assert graph.closure(root, e).count() == 20  # the dependency listing's own bound


def test_webhooks_are_the_plain_loop(spark):
    t = lambda d: None if d is None else datetime(2024, 1, d)
    arrived = [("v", 1, 1, True, "s", 5, "a"), ("v", 1, 2, True, "s", 6, "replay"), ("v", 2, 3, True, "s", 4, "stale"), ("v", 3, 4, False, "s", 9, "forged"), ("v", 4, 5, True, "s", None, "untimed"), ("v", 5, 6, True, "n", 1, "new"), ("v", 6, 7, True, "s", 8, "done before"), ("v", 7, 8, True, "s", 5, "equal")]
    ev = spark.createDataFrame([(v, i, t(r), ok, s, t(a), st) for v, i, r, ok, s, a, st in arrived], "vendor string, event_id int, received timestamp, valid boolean, subscription string, event_at timestamp, status string")
    known = spark.createDataFrame([("v", 6, "then"), ("v", 7, None)], "vendor string, event_id int, processed_at string")
    state = spark.createDataFrame([("s", "old", t(3)), ("x", "kept", None)], "subscription string, status string, event_at timestamp")
    log, after = tools.webhook_batch(ev, known, state, "now")
    assert rows(log, "event_id", "processed_at") == [(1, "now"), (2, "now"), (4, "now"), (5, "now"), (6, "then"), (7, "now")]
    stored = {"s": ("old", 3), "x": ("kept", None)}
    seen = {6}
    for _, i, _, ok, s, a, st in arrived:
        if not ok or i in seen:
            continue
        seen.add(i)
        status, top = stored.get(s, (None, None))
        if a is None or top is None or a >= top:
            status = st
        stored[s] = (status, max([x for x in (a, top) if x is not None], default=None))
    assert {r.subscription: (r.status, r.event_at and r.event_at.day) for r in after.collect()} == stored


def test_tasks_of_inherited_members_follow_the_rows(spark, monkeypatch):
    """of one owner a name's first row alone meets the starts, and these rows are dealt over as many tasks as they need."""
    monkeypatch.setattr(lineage, "TASK_ROWS", 5)
    tags = spark.createDataFrame([(s, n, d) for s in range(10) for n, d in ((s, 0), (100, 1), (101, 1))], "start long, name long, depth int")
    m = spark.createDataFrame([(o, f"f{i}", mod, "custom", t) for o in (3, 100, 101) for i in range(4) for mod, t in ((None, "char"), ("b", "x"), ("b", "a"))],
        "model long, name string, module string, edition string, ttype string")
    got = ranking.inherited_members(tags, m)
    assert rows(got.filter("start < 4"), "start", "name", "owner", "module", "ttype") == sorted(((s, f"f{i}", 3 if s == 3 else 100, "b", "a") for s in range(4) for i in range(4)), key=repr)
    assert got.rdd.getNumPartitions() == 17  # 84 rows, five a task
    listed = tools.fields_listing(tags, m)
    assert listed.filter("not builtin").count() == 40 and listed.filter("builtin").count() == 60


def test_tasks_of_counted_members_follow_the_rows(spark, monkeypatch):
    """names of a start's ancestors are counted once each; a start whose members have no name counts none."""
    monkeypatch.setattr(lineage, "TASK_ROWS", 5)
    tags = spark.createDataFrame([(s, n) for s in range(10) for n in (s, 100)] + [(50, 7)], "start long, name long")
    m = spark.createDataFrame([(100, f"f{i % 6}") for i in range(12)] + [(3, "f1"), (3, "own"), (7, None)], "model long, name string")
    asked = []
    deal = ranking.sized
    monkeypatch.setattr(ranking, "sized", lambda df, n, *keys: asked.append(n) or deal(df, n, *keys))
    assert rows(ranking.count_members(tags, m), "start", "n") == sorted(((s, {3: 7, 50: 0}.get(s, 6)) for s in [*range(10), 50]), key=repr)
    assert asked == [15, 64, 64, 64]


def test_edges_of_one_name_are_joined_without_a_last_distinct(spark, monkeypatch):
    """repeats go before the join."""
    monkeypatch.setattr(lineage, "TASK_ROWS", 5)
    m = spark.createDataFrame([("m", x, v, x < "c") for x in "abcdef" for v in ("1", "2") for _ in range(3)] + [("m", "z", "1", None)], "name string, module string, version string, is_definition boolean")
    got = store.same_name_inherits(m)
    assert rows(got, "version", "src_module", "dst_module") == sorted(((v, e, d) for v in "12" for e in "cdef" for d in "ab"), key=repr)
    assert got.count() == 16 and got.rdd.getNumPartitions() == 8  # 37 rows, five a task


def test_models_are_ranked_within_tasks_first(spark):
    """no task gets all models of a version; a version without definitions lists all, a null version none."""
    m = spark.createDataFrame([(f"m{i:03}", f"a{i % 7}", v, d) for i in range(150) for v, d in (("1", i % 2 == 0), ("2", False), ("3", None), (None, True))],
        "model string, module string, version string, is_definition boolean")
    uses = spark.createDataFrame([(f"u{i}", f"a{i % 3}", "1") for i in range(10)] * 2, "src string, dst string, version string")
    top = aggregates.top_models(m, uses, 5)
    assert rows(top.filter("version = '1'"), "place", "model", "module", "dependents") == [(i, f"m{k:03}", f"a{k % 7}", 4) for i, k in enumerate((0, 14, 28, 42, 56))]
    assert top.filter("version = '2'").count() == top.filter("version = '3'").count() == 5 and top.count() == 15
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_closure_compares_as_seldom_as_it_grows(spark, monkeypatch):
    """what was found is compared when it has doubled, not after each hop; depths stay the least, also where names are met again."""
    e = [(i, i + 1) for i in range(30)] + [(0, 3), (30, 0), (5, 5), (8, 2)]
    edges = spark.createDataFrame(e, "src int, dst int")
    best, front = {0: 0}, [0]
    while front:
        front = [b for a in front for x, b in e if x == a and b not in best and not best.update({b: best[a] + 1})]
    compared = []
    whole = graph.Growing.all
    monkeypatch.setattr(graph.Growing, "all", lambda self: compared.append(1) or whole(self))
    got = graph.closure(spark.createDataFrame([(0,)], "root int"), edges, None)
    assert rows(got, "name", "depth") == sorted(((n, d) for n, d in best.items() if d), key=repr)
    assert len(compared) <= 25
    assert rows(graph.closure(spark.createDataFrame([(0,)], "root int"), edges, 7), "name") == sorted(((n,) for n, d in best.items() if 0 < d <= 7), key=repr)


def test_tasks_of_declaring_modules_follow_the_rows(spark, monkeypatch, tmp_path):
    """lines are dealt over as many tasks as they need, and an order that is null counts for no module."""
    from codeloom.plans import QUERIES

    monkeypatch.setattr(lineage, "TASK_ROWS", 10)
    lines = [(p, s, o) for p in range(12) for s, o in ((1, p), (3, p), (3, p + 1), (6, None), (6, None))]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["declaring_rank"](spark, str(tmp_path))
    assert rows(got, "model", "module", "field_count", "dependents") == sorted(((p, "m3", 2, 13) for p in range(12)), key=repr)
    assert got.rdd.getNumPartitions() == 6  # 60 lines, ten a task


def test_fields_are_found_however_far_up(spark):
    """a field is found on an ancestor that is more than three hops up; cycles end, and the built-in and the nearest come first."""
    up = [(i, i + 1, "INHERITS") for i in range(3, 11)] + [(11, 9, "DELEGATES_TO"), (11, 4, "INHERITS"), (5, 5, "INHERITS"), (50, 10, "OTHER")]
    e = spark.createDataFrame(up, "src long, dst long, kind string")
    m = spark.createDataFrame([(11, "far", "b", "x"), (11, "far", "a", "y"), (6, "mid", None, "x"), (6, "mid", "m", "z"), (8, "mid", "a", "x"), (7, "id", "a", "x"), (7, "id", "a", "x")], "model long, name string, module string, ttype string")
    magic = spark.createDataFrame([("id", "integer")], "name string, ttype string")
    wanted = spark.createDataFrame([(s, f) for s in (3, 7, 9, 11, 50) for f in ("far", "mid", "id", "gone")] + [(3, "far")], "start long, field string")
    got = ranking.nearest_fields(wanted, e, m, magic, ("INHERITS", "DELEGATES_TO"))
    none = (None,) * 5
    want = [(3, "far", "inherited", 8, 11, "a", "y")] * 2 + [(7, "far", "inherited", 4, 11, "a", "y"), (9, "far", "inherited", 2, 11, "a", "y"), (11, "far", "direct", 0, 11, "a", "y"), (50, "far", *none)]
    want += [(3, "mid", "inherited", 3, 6, "m", "z"), (7, "mid", "inherited", 1, 8, "a", "x"), (9, "mid", "inherited", 5, 6, "m", "z"), (11, "mid", "inherited", 3, 6, "m", "z"), (50, "mid", *none)]
    want += [(s, "id", "magic", 0, s, None, "integer") for s in (3, 9, 11, 50)] + [(7, "id", "direct", 0, 7, "a", "x")] + [(s, "gone", *none) for s in (3, 7, 9, 11, 50)]
    assert rows(got, "start", "field", "step", "depth", "owner", "module", "ttype") == sorted(want, key=repr)


def _plain_members(tags, members):
    """The nearest owner's row of every start and name, as a loop finds it."""
    rank = {"community": 0, "enterprise": 1, "vendor": 2, "association": 3}
    low = lambda x: (x is not None, x or "")  # nulls first
    best: dict = {}
    for start, owner, depth in tags:
        for model, name, module, edition, ttype in members:
            if model == owner:
                order = (depth, rank.get(edition, 4), module is None, module or "", owner, low(edition), low(ttype))
                if (start, name) not in best or order < best[start, name][0]:
                    best[start, name] = (order, (start, name, owner, depth, module, edition, ttype))
    return sorted((row for _, row in best.values()), key=repr)


def test_members_travel_as_numbers(spark, monkeypatch):
    """what meets the starts holds no words, and gives the rows of a plain loop, with nulls and equal editions."""
    import random

    rng = random.Random(6)
    tags = sorted({(rng.randrange(20), rng.randrange(30)): rng.randrange(4) for _ in range(120)}.items())
    tags = [(s, o, d) for (s, o), d in tags]
    pick = lambda *x: rng.choice([None, *x])
    members = [(rng.randrange(30), pick(*(f"f{i}" for i in range(60))), pick("a", "b"), pick("vendor", "custom", "community"), pick("char", "x")) for _ in range(900)]
    moved = []
    deal = ranking.sized
    monkeypatch.setattr(ranking, "sized", lambda df, n, *keys: moved.append((keys, df.dtypes)) or deal(df, n, *keys))
    got = ranking.inherited_members(spark.createDataFrame(tags, "start long, name long, depth int"),
        spark.createDataFrame(members, "model long, name string, module string, edition string, ttype string"))
    assert rows(got, "start", "name", "owner", "depth", "module", "edition", "ttype") == _plain_members(tags, members)
    last = [types for keys, types in moved if keys[0] == "start"]
    assert len(last) == 1 and not [t for _, t in last[0] if "string" in t]
    empty = ranking.inherited_members(spark.createDataFrame(tags, "start long, name long, depth int"), spark.createDataFrame([], "model long, name string, module string, edition string, ttype string"))
    assert empty.count() == 0


def test_listed_fields_travel_as_numbers(spark, monkeypatch):
    """a listing's fields meet the starts without words, and those that every model has come where no owner declares them."""
    tags = [(s, n, d) for s in range(6) for n, d in ((s, 0), (100, 1), (101, 2))]
    members = [(100, "name", "b", "custom", "char"), (100, "name", "a", "custom", "x"), (101, "name", "a", "community", "y"), (2, "display_name", None, None, None), (101, "far", "m", "vendor", "char")]
    moved = []
    deal = ranking.sized
    monkeypatch.setattr(ranking, "sized", lambda df, n, *keys: moved.append((keys, df.dtypes)) or deal(df, n, *keys))
    got = tools.fields_listing(spark.createDataFrame(tags, "start long, name long, depth int"), spark.createDataFrame(members, "model long, name string, module string, edition string, ttype string"))
    want = [(r[0], r[1], r[2], r[6], False) for r in _plain_members(tags, members)]
    want += [(s, n, s, t, True) for s in range(6) for n, t, _ in scalars.MAGIC_FIELDS if (s, n) != (2, "display_name")]
    assert rows(got, "start", "name", "owner", "ttype", "builtin") == sorted(want, key=repr)
    assert [keys for keys, types in moved if keys[0] == "start" and any("string" in t for _, t in types)] == []
