"""Incremental ingest from commits and trees."""

from __future__ import annotations

import random

import pytest

from codeloom.operators import history

COMMIT, TREE = "repo string, sha string, parents array<string>", "repo string, path string, blob string"
#     a - b - d - f      and a rewritten line x - y
#       \\ c /
COMMITS = [("r", "a", []), ("r", "b", ["a"]), ("r", "c", ["a"]), ("r", "d", ["b", "c"]), ("r", "f", ["d"]), ("r", "x", []), ("r", "y", ["x"]), ("s", "a", []), ("s", "n", ["lost"])]


def test_ancestors(spark):
    pairs = [("r", "a", "f", True), ("r", "c", "f", True), ("r", "f", "f", True), ("r", "f", "a", False), ("r", "b", "c", False), ("r", "x", "f", False), ("r", "x", "y", True), ("s", "f", "a", False),
        ("s", "lost", "n", False), ("s", "never", "never", True), ("r", None, "f", False)]
    got = history.is_ancestor(spark.createDataFrame([p[:3] for p in pairs], "repo string, old string, new string"), spark.createDataFrame(COMMITS, COMMIT))
    assert {(r.repo, r.old, r.new): r.ancestor for r in got.collect()} == {p[:3]: p[3] for p in pairs}


@pytest.mark.parametrize("seed", range(2))
def test_ancestors_of_random_histories(spark, seed):
    rng = random.Random(seed)
    commits = [("r", str(i), [str(rng.randrange(max(0, i - 6), i)) for _ in range(rng.choice([0, 1, 1, 1, 2]))] if i else []) for i in range(60)]
    above: dict = {}
    for _, sha, parents in commits:
        above[sha] = {sha}.union(*(above[p] for p in parents))
    pairs = [("r", str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(40)]
    got = history.is_ancestor(spark.createDataFrame(pairs, "repo string, old string, new string").distinct(), spark.createDataFrame(commits, COMMIT))
    assert all(r.ancestor == (r.old in above[r.new]) for r in got.collect())


def test_changed_modules(spark):
    old = [("m/__manifest__.py", "1"), ("m/a.py", "1"), ("m/sub/__openerp__.py", "1"), ("m/sub/b.py", "1"), ("gone/__manifest__.py", "1"), ("gone/c.py", "1"), ("same/__manifest__.py", "1"), ("doc/x.md", "1"), ("moved/z.py", "7")]
    new = [("m/__manifest__.py", "1"), ("m/a.py", "1"), ("m/sub/__openerp__.py", "1"), ("m/sub/b.py", "2"), ("same/__manifest__.py", "1"), ("doc/x.md", "2"), ("fresh/__manifest__.py", "1"), ("root.py", "1"), ("__manifest__.py", "1"),
        ("moved/z.py", "7")]
    tree = lambda rows, repo: [(repo, *r) for r in rows]
    make = lambda rows: spark.createDataFrame(rows, TREE)
    before, after = make(tree(old, "r") + tree(old, "s") + tree(old, "t")), make(tree(new, "r") + tree(new, "s") + tree(new, "t"))
    assert sorted(r.path for r in history.changed_files(before, after).filter("repo = 'r'").collect()) == ["__manifest__.py", "doc/x.md", "fresh/__manifest__.py", "gone/__manifest__.py", "gone/c.py", "m/sub/b.py", "root.py"]
    heads = spark.createDataFrame([("r", "b", "f"), ("s", "gone", "a"), ("t", "q", "q"), ("u", None, "z")], "repo string, old string, new string")
    modes, modules = history.ingest_plan(heads, spark.createDataFrame(COMMITS, COMMIT), before, after)
    assert {r.repo: r.mode for r in modes.collect()} == {"r": "incremental", "s": "full", "t": "skip", "u": "full"}
    assert sorted((r.repo, r.module, r.mode) for r in modules.collect()) == [("r", "fresh", "incremental"), ("r", "m/sub", "incremental")] + [("s", m, "full") for m in ("fresh", "m", "m/sub", "same")]


def test_walks_broadcast_nothing(spark, monkeypatch):
    """Rounds of a walk join by shuffle: what grows with the graph is never gathered in the driver."""
    from codeloom.operators import graph, lineage, ordering

    plans = []

    class Watched(lineage.Growing):
        def add(self, part):
            plans.append(part._jdf.queryExecution().executedPlan().toString())
            return super().add(part)

    monkeypatch.setattr(ordering, "Growing", Watched)
    monkeypatch.setattr(graph, "Growing", Watched)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    names = spark.createDataFrame([(i,) for i in range(1, 5)], "name int")
    assert ordering.reach(names.selectExpr("name as start"), links).count() == 10
    assert {(r.name, r.level) for r in graph.levels(links, names).collect()} == {(4, 0), (3, 1), (2, 2), (1, 3)}
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
