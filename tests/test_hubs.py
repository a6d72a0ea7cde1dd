"""The factored form of calls gives what the written-out edges give."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import graph, impact, rank, structure
from tributary.plans import analysis


def corpus(seed, files=12, names=9):
    rnd = random.Random(seed)
    for i in range(files):
        lines = [f"import f{rnd.randrange(files)}"]
        for _ in range(rnd.randrange(1, 5)):
            lines += [f"def n{rnd.randrange(names)}(a):"] + [f"    n{rnd.randrange(names + 2)}(a)" for _ in range(rnd.randrange(3))] + ["    return a"]
        if rnd.random() < 0.5:
            lines.append(f"n{rnd.randrange(names)}(1)")
        if rnd.random() < 0.3:
            lines += [f"class n{rnd.randrange(names)}:", "    def get(self): x.get()"]
        yield (f"r{seed}", "c", f"f{i}.py", "\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def built(spark):
    rows = [r for seed in range(3) for r in corpus(seed)]
    files = spark.createDataFrame(rows, "repo string, commit_sha string, path string, content string")
    s = analysis.read_symbols(files)
    return s, analysis.build_graph(s)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_and_flags(built):
    s, g = built
    every = (
        graph.defines_edges(s.classes, s.functions)
        .unionByName(graph.call_edges(s.calls, graph.name_index(s.classes, s.functions)))
        .unionByName(graph.import_edges(s.imports, g.nodes))
    )
    cols = ["repo", "source", "target", "type"]
    edges = graph.collapse_edges(every)
    assert collected(g.edges.select(cols)) == collected(edges.select(cols))
    plain = graph.with_entry_flag(g.nodes.drop("is_entry_point"), edges)
    assert collected(plain.select("repo", "id", "is_entry_point")) == collected(g.nodes.select("repo", "id", "is_entry_point"))
    cols = ["repo", "file", "line", "message"]
    assert collected(structure.dead_code(g.nodes, edges).select(cols)) == collected(structure.dead_flagged(g.nodes).select(cols))


@pytest.mark.parametrize("chunk", [2, 2_000_000])
def test_rank_and_reach(built, chunk):
    _, g = built
    a = rank.pagerank(g.nodes, g.edges, iterations=4, digits=10)
    b = rank.pagerank(g.nodes, g.hubs.direct, iterations=4, digits=10, hubs=g.hubs, rows_per_chunk=chunk)
    assert collected(a) == collected(b.select(a.columns))
    seeds = g.nodes.filter("type = 'class' OR label = 'n1'").select("repo", "commit_sha", F.col("label").alias("seed"), "id")
    a = impact.blast_radius(g.edges, seeds, paths=True)
    b = impact.blast_radius(g.hubs.direct, seeds, paths=True, hubs=g.hubs, rows_per_chunk=chunk)
    assert collected(a) == collected(b.select(a.columns))
