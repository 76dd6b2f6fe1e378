"""Sinks that write, post-passes by their rules, the retry ladder, the vector index, orders and chains."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import ann, embedding, graph, ordering, sinks, store, validate


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


NODE = "id string, kind string, module string, version string, unresolved boolean"


def nodes(spark):
    u = store.UNRESOLVED
    return spark.createDataFrame([("a", "Model", u, "v", True), ("b", "View", "sale", "v", True), ("c", "View", u, "v", None), ("d", "Model", "sale", "v", True), ("e", "View", u, "w", True),
        ("f", "QWebTmpl", None, "v", True), ("g", "Field", u, "v", True)], NODE)


def edges(spark):
    return spark.createDataFrame([("b", "a", True), ("a", "b", True), ("d", "b", True), ("b", "c", True), ("b", "e", True), ("b", "d", True), ("d", "f", None), ("d", "gone", True)], "src string, dst string, unresolved boolean")


def test_placeholders_go_with_their_edges_and_real_rows_are_healed(spark):
    left, links = store.gc_placeholders(nodes(spark), edges(spark), "v")
    assert rows(left, "id", "unresolved") == [("b", False), ("c", None), ("d", True), ("e", True), ("f", False), ("g", True)]
    assert rows(links, "src", "dst", "unresolved") == [("b", "c", True), ("b", "d", False), ("b", "e", True), ("d", "b", False), ("d", "f", None), ("d", "gone", True)]
    again = store.gc_placeholders(left, links, "v")
    assert rows(again[0], *left.columns) == rows(left, *left.columns) and rows(again[1], *links.columns) == rows(links, *links.columns)


def test_bundles_and_stubs(spark):
    ids = lambda *x: spark.createDataFrame([(i, "v") for i in x], "id string, version string")
    pair = lambda a, b, *x: spark.createDataFrame(list(x), f"{a} string, {b} string")
    left = store.gc_bundles(ids("given", "includes", "included", "extended", "extends", "lone"), pair("module", "bundle", ("m", "given")), pair("src", "dst", ("includes", "included")), pair("src", "dst", ("extends", "extended")), "v")
    assert rows(left, "id") == [("extended",), ("given",), ("included",), ("includes",)]
    m = spark.createDataFrame([("real", "v", 1), ("stub", "v", None), ("parent", "v", None), ("other", "w", None)], "id string, version string, repo_id int")
    left, links = store.gc_dep_stubs(m, spark.createDataFrame([("parent",)], "module string"), pair("src", "dst", ("real", "stub"), ("real", "parent")), "v")
    assert rows(left, "id") == [("other",), ("parent",), ("real",)] and rows(links, "src", "dst") == [("real", "parent")]


def test_a_repository_goes_with_its_children(spark):
    m = spark.createDataFrame([("M1", "a", "r", "v"), ("M2", "b", "s", "v"), ("M3", "a", "r", "w"), ("M4", "n", None, "v")], "id string, name string, repo string, version string")
    n = spark.createDataFrame([("1", "Model", "a", "v"), ("2", "Model", "b", "v"), ("3", "Model", "a", "w"), ("4", "AssetBundle", "a", "v"), ("5", "View", None, "v")], "id string, kind string, module string, version string")
    e = spark.createDataFrame([("1", "M1"), ("2", "M2"), ("2", "1"), ("4", "M2")], "src string, dst string")
    modules, left, links = store.delete_repo(m, n, e, "r", "v")
    assert (rows(modules, "id"), rows(left, "id"), rows(links, "src", "dst")) == ([("M2",), ("M3",), ("M4",)], [("2",), ("3",), ("4",), ("5",)], [("2", "M2"), ("4", "M2")])


def test_classes_with_tests_are_never_promoted(spark):
    c = spark.createDataFrame([("1", "Base", "m", "v", True, None, ["p"]), ("2", "Tested", "m", "v", False, None, ["p"]), ("3", "Leaf", "m", "v", True, None, None), ("4", "Old", "m", "v", None, True, None)],
        "id string, name string, module string, version string, defines_no_test_methods boolean, is_helper boolean, profile array<string>")
    h = spark.createDataFrame([("Base", "m", "v", "framework", ["q"])], "name string, module string, version string, origin string, profile array<string>")
    classes, helpers = store.promote_helpers(c, spark.createDataFrame([("3", "1"), ("3", "2")], "src string, dst string"), h)
    assert rows(classes, "id", "is_helper") == [("1", True), ("2", False), ("3", False), ("4", True)]
    assert rows(helpers, "name", "origin", "profile") == [("Base", "addon", ["q", "p"]), ("Old", "addon", [])]


# sinks

KIND = "module string, k int, v double"


def make(spark, tmp_path, buckets=8):
    table = sinks.SnapshotTable(spark, f"file://{tmp_path}/t", KIND, ["module"], buckets)
    return table, lambda *r: spark.createDataFrame([(m, k, None if v is None else float(v)) for m, k, v in r], KIND)


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    table, some = make(spark, tmp_path)
    assert table.read().count() == 0 and table.version() == 0
    table.rewrite(some(("a", 1, 1), ("b", 1, 2)), lambda old, new: new)
    before = rows(table.read(), "module", "k", "v")

    def broken(old, new):
        return new.withColumn("v", F.raise_error(F.lit("cut off")).cast("double"))

    with pytest.raises(Exception, match="cut off"):
        table.rewrite(some(("a", 9, 9)), broken)
    assert rows(table.read(), "module", "k", "v") == before and table.version() == 1
    sinks.write_vectors(table, some(("a", 9, 9)), "v", ["module", "k"], "k")
    assert rows(table.read(), "module", "k", "v") == [("a", 9, 9.0), ("b", 1, 2.0)]
    assert rows(table.read(1), "module", "k", "v") == before  # readers of the old snapshot still see it


def test_of_two_writers_one_fails_whole(spark, tmp_path):
    table, some = make(spark, tmp_path)
    table.rewrite(some(("a", 1, 1), ("b", 1, 1)), lambda old, new: new)

    def while_another_commits(old, new):
        sinks.write_vectors(make(spark, tmp_path)[0], some(("b", 7, 7)), "v", ["module"], "k")
        return new

    with pytest.raises(sinks.WriteConflict):
        table.rewrite(some(("a", 2, 2)), while_another_commits)
    assert rows(table.read(), "module", "k") == [("a", 1), ("b", 7)]
    table.rewrite(some(("a", 2, 2)), lambda old, new: new)
    table.vacuum(keep=1)
    assert rows(table.read(), "module", "k") == [("a", 2), ("b", 7)]
    with pytest.raises(Exception):
        table.read(1).count()


def test_scopes_without_a_vector_keep_their_rows(spark, tmp_path):
    table, some = make(spark, tmp_path, 2)
    table.rewrite(some(("a", 1, 1), ("b", 1, 2), ("c", 1, 3)), lambda old, new: new)
    for _ in range(2):  # the second write changes nothing
        sinks.write_vectors(table, some(("a", 5, None), ("b", 5, None), ("b", 6, 6), ("b", 6, 7), ("d", 1, None)), "v", ["module", "k"], "v")
        assert rows(table.read(), "module", "k", "v") == [("a", 1, 1.0), ("b", 6, 7.0), ("c", 1, 3.0)]
    assert table.rewrite(some(), lambda old, new: new) == 3
    with pytest.raises(ValueError):
        sinks.write_graph(table, some(("a", 1, 1)), ["k"])


# embedding


class Flaky:
    """Fails its first calls, refuses texts with 'poison', and may return too few vectors."""

    model, dim = "flaky", 1

    def __init__(self, fails=0, short=False):
        self.fails, self.short, self.calls = fails, short, 0

    def embed(self, texts):
        self.calls += 1
        if self.calls <= self.fails or any("poison" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts][: 1 if self.short else None]


def test_the_ladder():
    one = Flaky()
    assert [r for _, r, _ in embedding.climb(one, ["a", "b"])] == ["batch"] * 2 and one.calls == 1
    two = Flaky(1)
    assert [r for _, r, _ in embedding.climb(two, ["a", "b"])] == ["again"] * 2 and two.calls == 2
    bad = Flaky()
    assert embedding.climb(bad, ["a", "poison", "ccc"]) == [([1.0], "single", None), (None, "failed", "refused"), ([3.0], "single", None)] and bad.calls == 5
    assert [r for _, r, _ in embedding.climb(Flaky(9), ["a", "b"])] == ["failed"] * 2
    assert [r for _, r, _ in embedding.climb(Flaky(short=True), ["a", "b"])] == ["single"] * 2


def test_poison_costs_only_itself(spark):
    d = spark.createDataFrame([("m", i, "poison" if i == 7 else None if i == 8 else f"t{i}") for i in range(30)] + [("n", 99, "poison")], "module string, i int, content string").repartition(2)
    e = embedding.embed_rows(d, Flaky, batch=4)
    assert e.count() == 31 and rows(e.filter("embedding is null"), "i", "rung", "error") == [(7, "failed", "refused"), (99, "failed", "refused")]
    assert rows(embedding.outcomes(e, "module"), "module", "chunks", "embedded", "failed") == [("m", 30, 29, 1), ("n", 1, 0, 1)]
    assert e.filter("i = 8").first().embedding == [0.0]
    assert embedding.foreign_space(e, "flaky", 1).count() == 0
    assert rows(embedding.foreign_space(e, "other", 1), "model", "dim", "n") == [("flaky", 1, 29)]
    assert rows(embedding.foreign_space(e.withColumn("model", F.lit(None).cast("string")), "x", 2), "dim", "n") == [(1, 29)]


# vector index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 1, (12, 8))
    data = [(int(i), [float(x) for x in middle[i % 12] + rng.normal(0, 0.2, 8)], int(i % 50)) for i in range(1500)]
    odd = [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, data[5][1], 5)]
    return spark.createDataFrame(data + odd, "id long, embedding array<float>, tag int")


def nearest(df, q, k, keep=lambda r: True):
    x = {r.id: np.array(r.embedding, float) for r in df.collect() if r.embedding and np.isfinite(r.embedding).all() and any(r.embedding) and keep(r)}
    q = np.array(q, float)
    return sorted(x, key=lambda i: (-round(float(x[i] @ q / np.linalg.norm(x[i]) / np.linalg.norm(q)), 12), i))[:k]


def test_index_prunes_lists_and_finds_most(spark, vectors):
    index = ann.build_index(vectors, 12, sample_rows=600)
    assert index.rows().count() == 1501 and index.sizes.sum() == 1501
    assert "tag" in index.rows().columns
    q = vectors.filter("id % 100 = 0 and id < 1500").select(F.col("id").alias("query"), "embedding")
    truth = ann.exact(vectors, q, 10)
    probes = ann.probes_for(index, vectors.filter("id % 100 = 3 and id < 1500").select(F.col("id").alias("query"), "embedding"), 10)
    got = ann.recall(ann.search(index, q, 10, probes), truth, "id").agg(F.sum("hits") / F.sum("wanted")).first()[0]
    assert got >= 0.9 and probes < 12
    for r in q.collect():
        assert [x.id for x in truth.filter(F.col("query") == r.query).orderBy("place").collect()] == nearest(vectors, r.embedding, 10)
    plan = index.rows([3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan


@pytest.mark.parametrize("condition,keep", [(None, lambda r: True), ("tag = 7", lambda r: r.tag == 7), ("tag = 70", lambda r: False)])
def test_search_widens_until_it_is_exact(spark, vectors, condition, keep):
    index = ann.build_index(vectors, 12, sample_rows=600)
    q = vectors.filter("id in (0, 300, 701)").select(F.col("id").alias("query"), "embedding")
    found, rounds = ann.search_until_full(index, q, 20, condition and F.expr(condition), first=1)
    for r in q.collect():
        assert [x.id for x in found.filter(F.col("query") == r.query).orderBy("place").collect()] == nearest(vectors, r.embedding, 20, keep)
    assert rounds[0] == 3 and (len(rounds) > 1 or condition is None)


def test_index_of_odd_tables(spark, vectors):
    none = ann.build_index(vectors.filter("id = 2001"), 4)
    q = vectors.filter("id = 0").select(F.col("id").alias("query"), "embedding")
    assert ann.search(none, q, 5, 2).count() == 0 and ann.search_until_full(none, q, 5)[0].count() == 0
    assert ann.search_until_full(ann.build_index(vectors.filter("id < 9"), 4), q.filter("query < 0"), 5)[0].count() == 0


# orders and chains


@pytest.mark.parametrize("seed", range(3))
def test_kahn_order_equals_the_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"{rng.choice('abcxyz')}{i}" for i in range(40)]
    links = [(names[i], names[rng.randrange(i)]) for i in range(1, 40) for _ in range(rng.randint(0, 2))] + [(n, n) for n in names if rng.random() < 0.03]
    links += [(names[5], names[30]), (names[30], names[5]), (names[9], "missing"), ("outside", names[3])] if seed else []
    got = ordering.kahn_order(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(n,) for n in names], "name string"))
    depends: dict = {}
    for a, b in links:
        depends.setdefault(a, []).append(b)
    assert [r.name for r in got.orderBy("place").collect()] == graph.topological_order(names, depends)


def test_names_on_and_above_a_cycle_come_last(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("e", "d"), ("f", "f")], "src string, dst string")
    got = ordering.kahn_order(e, spark.createDataFrame([(x,) for x in "abcdef"], "name string"))
    assert [(r.name, r.wave) for r in got.orderBy("place").collect()] == [("d", 0), ("e", 1), ("a", None), ("b", None), ("c", None), ("f", None)]


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    add = ordering.Growing.add
    monkeypatch.setattr(ordering.Growing, "add", lambda self, part: rounds.append(1) or add(self, part))
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1001)], "name long, parent long")
    got = graph.chain(spark.createDataFrame([(1000,), (3,)], "start long"), parents)
    assert got.count() == 1001 + 4 and got.filter("start = 1000 and name = 0").first().depth == 1000
    assert len(rounds) <= 12


def test_chains_end_on_cycles_and_diamonds(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "x")], "src string, dst string")
    got = ordering.reach(spark.createDataFrame([("a",), ("x",), ("alone",)], "start string"), links)
    assert rows(got, "start", "name", "depth") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("alone", "alone", 0), ("x", "x", 0)]


def test_long_dependency_paths_are_walked_to_their_end(spark):
    m = spark.createDataFrame([(f"m{i}", "next", "many2one", f"m{i + 1}") for i in range(20)] + [("m6", "x", "char", None)], "model string, name string, ttype string, comodel string")
    d = spark.createDataFrame([("m0", "c", [".".join(["next"] * 6 + ["x"]), ".".join(["next"] * 19), ".".join(["next"] * 21), "next"])], "model string, name string, depends array<string>")
    assert [r.problem for r in validate.check_depends(d, m).orderBy(F.length("dependency")).collect()] == [None, None, None, "missing"]


def test_newest_versions_are_not_cut(spark):
    from codeloom.operators.ranking import newest_versions
    names = [f"{a}.{b}" for a in range(12) for b in range(5)] + ["main", "x.1"]
    got = [r.version for r in newest_versions(spark.createDataFrame([(n,) for n in names], "version string")).orderBy("place").collect()]
    assert got == sorted(names[:60], key=lambda v: [-int(x) for x in v.split(".")]) + ["main", "x.1"]


def test_few_starts_walk_by_pushed_filters(spark):
    rng = random.Random(3)
    e = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), rng.choice(["INHERITS", "DELEGATES_TO"]), rng.choice([None, "f1", "f2"])) for _ in range(90)], "src long, dst long, kind string, via_field string")
    for names, hops, kinds in (([1, 2, 3], 3, ("INHERITS", "DELEGATES_TO")), ([5], 5, ("INHERITS",)), ([], 2, ("INHERITS",)), ([99], 2, ("INHERITS",))):
        want = rows(graph.ancestors(spark.createDataFrame([(n,) for n in names], "start long"), e, hops, kinds), "start", "name", "depth", "kind", "via_field")
        tags, found = graph.ancestors_of(names, e, hops, kinds)
        assert rows(tags, "start", "name", "depth", "kind", "via_field") == want and found == sorted({r[1] for r in want})
        if names:
            over, none = graph.ancestors_of(names, e, hops, kinds, most=0)
            assert rows(over, "start", "name", "depth", "kind", "via_field") == want and (none is None or len(want) == len(names))


def test_single_requests_read_a_filtered_scan(spark):
    from codeloom.plans import QUERIES
    plan = QUERIES["one_model_members"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = plan[plan.index("PushedFilters") :]
    assert "In(l_partkey" in scan or "EqualTo(l_partkey" in scan


def test_suggestions_equal_all_pairs(spark):
    """Pairs that meet by rare letters are all that difflib calls alike."""
    from difflib import SequenceMatcher
    rng = random.Random(8)
    base = ["partner_id", "amount_total", "state", "x", "", "aaaa", "aaab", "name_get", "éà_ü", "line_ids", "zz"]
    def worn(n):
        letters = list(n)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "_", "zq", "é"])
        return "".join(letters)
    wanted = sorted({(rng.choice("AB"), worn(rng.choice(base))) for _ in range(150)})
    names = sorted({(rng.choice("AB"), worn(rng.choice(base))) for _ in range(150)})
    got = validate.suggest(spark.createDataFrame(wanted, "model string, name string"), spark.createDataFrame(names, "model string, name string"), "model")
    want = {}
    for m, n in wanted:
        rated = [(SequenceMatcher(None, c, n).ratio(), c) for k, c in names if k == m]
        best = max((r for r in rated if r[0] >= 0.7 and r[1] and n), default=(0, None))
        want[m, n] = best[1]
    have = {(r.model, r.name): r.suggestion for r in got.collect()}
    assert {k: v for k, v in have.items() if k[1]} == {k: v for k, v in want.items() if k[1]} and sum(v is not None for v in have.values()) > 40


def test_suggestions_deal_a_key_into_blocks(spark, monkeypatch):
    """Blocks of a key's names meet in tasks of their own, with the answer of one block."""
    names = spark.createDataFrame([("m", f"field_{i}") for i in range(60)], "model string, name string")
    wanted = spark.createDataFrame([("m", f"fild_{i}") for i in range(0, 60, 3)], "model string, name string")
    whole = sorted(map(tuple, validate.suggest(wanted, names, "model").collect()))
    monkeypatch.setattr(validate, "BLOCK_NAMES", 7)
    assert all(r[2] for r in whole) and sorted(map(tuple, validate.suggest(wanted, names, "model").collect())) == whole


def test_most_candidates_are_left_unrated(monkeypatch):
    """names with the same letters in another order are told apart by the tree, without rating each pair; long names and equal ratios too are difflib's."""
    from difflib import SequenceMatcher

    from codeloom.operators import alike
    rated = []

    class Counted(SequenceMatcher):
        def ratio(self):
            rated.append(1)
            return super().ratio()

    monkeypatch.setattr(alike, "SequenceMatcher", Counted)
    names = [f"Supplier#{i:09d}" for i in range(0, 40_000, 40)]
    wrong, near = [n[9:][::-1] + n[:9] for n in names[:50]], [n.replace("pp", "p") for n in names[:50]]
    assert alike.nearest(wrong, names, 0.7) == [None] * 50 and not rated
    assert [b[1] for b in alike.nearest(near, names, 0.7)] == names[:50] and len(rated) < 500
    monkeypatch.setattr(alike, "FRONT", 20)
    rng = random.Random(5)
    some = lambda: "".join(rng.choice(["ab", "x", "é"]) for _ in range(rng.choice([2, 5, 60])))
    names, wanted = [some() for _ in range(80)], [some() for _ in range(80)]
    best = [max((r for r in ((SequenceMatcher(None, c, n).ratio(), c) for c in names) if r[0] >= 0.7), default=None) for n in wanted]
    assert alike.nearest(wanted, names, 0.7) == best and None in best and any(best)


def test_profile_pages_of_names_in_several_repositories(spark):
    """Profiles alike share an answer; a module of two repositories counts once."""
    from codeloom.operators import tools
    rng = random.Random(3)
    parent = {i: (rng.randrange(i) if i and i % 5 else None) for i in range(30)}
    repos = sorted({(rng.randrange(8), rng.randrange(12)) for _ in range(20)})
    modules = sorted({(f"m{rng.randrange(40)}", rng.randrange(8)) for _ in range(90)})
    got = tools.profile_modules(spark.createDataFrame(list(parent.items()), "name int, parent int"), spark.createDataFrame(repos, "repo int, profile int"),
        spark.createDataFrame(modules, "name string, repo int"), 1, 6)
    want = set()
    for p in parent:
        up, at = set(), p
        while at is not None:
            up.add(at)
            at = parent[at]
        names = sorted({n for n, r in modules if any((r, q) in repos for q in up)})
        want |= {(p, n, i + 1, len(names)) for i, n in enumerate(names) if 6 <= i < 12}
    assert want and {(r.profile, r.name, r.place, r.total) for r in got.collect()} == want


def test_growing_sides_are_not_broadcast(spark):
    """Sides that grow with the input are joined by shuffle, however small Spark guesses them."""
    from codeloom.plans import QUERIES
    for name in ("field_lookup", "test_coverage"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") <= (name == "field_lookup"), plan  # the few built-in fields alone
