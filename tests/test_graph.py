import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import graph, rank, symbols

FILES = [
    ("r", "c", "a.py", "import b\nimport pkg.c\nfrom .b import run\ndef run():\n    go()\n    x.get()\nrun()\n"),
    ("r", "c", "b.py", "class run:\n    def get(self):\n        self.get()\n        missing()\ndef go(): return run()\n"),
    ("r", "c", "pkg/c.py", "def get():\n    pass\ndef get():\n    return 1\n"),
    ("r", "c", "pkg/b.py", "from .c import get\n"),
    ("other", "c", "a.py", "def go():\n    pass\n"),
]


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame(FILES, "repo string, commit_sha string, path string, content string")
    parsed = symbols.parse_files(df).cache()
    return parsed, symbols.classes(parsed), symbols.functions(parsed), symbols.imports(parsed), symbols.call_sites(parsed)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_nodes_last_definition_wins(tables):
    parsed, classes, functions, _, _ = tables
    nodes = graph.nodes(parsed, classes, functions)
    assert nodes.groupBy("repo", "commit_sha", "id").count().filter("count > 1").isEmpty()
    get = nodes.filter("id = 'pkg/c.py::get'").first()
    assert (get.type, get.start_line) == ("function", 3)
    assert nodes.filter("type = 'file'").count() == 5


@pytest.mark.parametrize("chunk", [1, 2_000_000])
def test_call_resolution(tables, chunk):
    parsed, classes, functions, _, calls = tables
    index = graph.name_index(classes, functions)
    nodes = graph.nodes(parsed, classes, functions)
    got = rows(graph.call_edges(calls, index, nodes, rows_per_chunk=chunk), "repo", "source", "target")
    assert got == {
        ("r", "a.py::run", "b.py::go"),
        ("r", "a.py::run", "b.py::get"),
        ("r", "a.py::run", "pkg/c.py::get"),
        ("r", "a.py", "a.py::run"),
        ("r", "a.py", "b.py::run"),
        ("r", "b.py::get", "b.py::get"),
        ("r", "b.py::get", "pkg/c.py::get"),
        ("r", "b.py::go", "a.py::run"),
        ("r", "b.py::go", "b.py::run"),
    }
    assert rows(graph.unresolved_calls(calls, index), "source", "name") == {("b.py::get", "missing")}


def test_imports_and_collapse(tables):
    parsed, classes, functions, imports, calls = tables
    nodes = graph.nodes(parsed, classes, functions)
    found = graph.import_edges(imports, nodes)
    assert rows(found, "source", "target") == {("a.py", "b.py"), ("a.py", "pkg/c.py")}
    near = graph.import_edges(imports, nodes, resolve_relative=True)
    assert ("pkg/b.py", "pkg/c.py") in rows(near, "source", "target")
    every = (
        graph.defines_edges(classes, functions)
        .unionByName(graph.call_edges(calls, graph.name_index(classes, functions)))
        .unionByName(found)
    )
    types = {(r.source, r.target): r.type for r in graph.collapse_edges(every).filter("repo = 'r'").collect()}
    assert types[("a.py", "a.py::run")] == "calls"  # the module's call replaces the definition
    assert types[("b.py", "b.py::run")] == "defines"
    both = rows(graph.collapse_edges(every, multi=True), "source", "target", "type")
    assert {("a.py", "a.py::run", "calls"), ("a.py", "a.py::run", "defines")} <= both


def test_entry_points(spark):
    nodes = spark.createDataFrame(
        [("r", "c", i, t) for i, t in [("f", "function"), ("g", "function"), ("self", "function"), ("k", "class")]],
        "repo string, commit_sha string, id string, type string",
    )
    edges = spark.createDataFrame(
        [("r", "c", "f", "g", "calls"), ("r", "c", "self", "self", "calls"), ("r", "c", "x", "f", "defines")],
        "repo string, commit_sha string, source string, target string, type string",
    )
    assert rows(graph.entry_points(nodes, edges), "id") == {("f",)}
    flags = {r.id: r.is_entry_point for r in graph.with_entry_flag(nodes, edges).collect()}
    assert flags == {"f": True, "g": False, "self": False, "k": False}
    untyped = edges.withColumn("type", F.lit(None).cast("string"))
    assert rows(graph.export_edges(untyped), "type") == {("unknown",)}


def power(n, edges, alpha=0.85, tol=1e-6, rounds=100):
    """Dense power method with evenly spread dangling mass."""
    m = np.zeros((n, n))
    for s, t in edges:
        m[s, t] = 1.0
    out = m.sum(axis=1)
    loose = out == 0
    m[~loose] /= out[~loose, None]
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = alpha * (x @ m + x[loose].sum() / n) + (1 - alpha) / n
        change, x = np.abs(new - x).sum(), new
        if change < n * tol:
            return x
    return np.zeros(n)


@pytest.mark.parametrize("chunk", [2, 2_000_000])
def test_pagerank_per_repository(spark, chunk):
    rnd = random.Random(5)
    graphs = {"one": (12, {(rnd.randrange(12), rnd.randrange(12)) for _ in range(25)}), "two": (5, {(0, 1), (1, 2), (2, 0)}), "lone": (1, set())}
    graphs["hub"] = (9, {(0, i) for i in range(1, 9)} | {(3, 0)})
    nodes = [(r, "c", f"n{i}") for r, (n, _) in graphs.items() for i in range(n)]
    edges = [(r, "c", f"n{s}", f"n{t}", "calls") for r, (_, es) in graphs.items() for s, t in es]
    nodes = spark.createDataFrame(nodes, "repo string, commit_sha string, id string")
    edges = spark.createDataFrame(edges, "repo string, commit_sha string, source string, target string, type string")
    got = rank.pagerank(nodes, edges, digits=None, rows_per_chunk=chunk).collect()
    for repo, (n, es) in graphs.items():
        want = power(n, es)
        mine = {r.id: r.centrality for r in got if r.repo == repo}
        assert len(mine) == n
        assert np.allclose([mine[f"n{i}"] for i in range(n)], want, atol=1e-12)
        assert abs(sum(mine.values()) - 1) < 1e-6
    if chunk > 2:
        stuck = rank.pagerank(nodes, edges, max_iter=2, tol=1e-12).filter("repo = 'one'")
        assert rows(stuck, "centrality") == {(0.0,)}


def test_rounds_of_pagerank_hold_numbers_only(spark, monkeypatch):
    held, stage = {}, rank.stage
    monkeypatch.setattr(rank, "stage", lambda df, label: held.update({label: dict(df.dtypes)}) or stage(df, label))
    nodes = spark.createDataFrame([("r", "c", i) for i in ("a", "b", "b", None)], "repo string, commit_sha string, id string")
    edges = spark.createDataFrame(
        [("r", "c", s, t) for s, t in [("a", "b"), ("a", "b"), ("a", "gone"), ("a", None), ("x", "a"), (None, "b")]],
        "repo string, commit_sha string, source string, target string",
    )
    got = {r.id: r.centrality for r in rank.pagerank(nodes, edges, iterations=1, digits=None).collect()}
    rounds = [types for label, types in held.items() if label in ("rank-0", "rank-1")]
    assert len(rounds) == 2 and not any("string" in types.values() for types in rounds)
    # Three targets of a, one of them no node; b counts twice among four, and two rows of it and null have no way out.
    base = 0.85 * 0.75 / 4 + 0.15 / 4
    assert np.allclose([got["a"], got["b"], got[None]], [base, base + 0.85 / 12, base + 0.85 / 12])
