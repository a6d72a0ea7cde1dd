import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tributary.operators import impact

NODE = "repo string, commit_sha string, id string"
EDGE = "repo string, commit_sha string, source string, target string, type string"


def staged_tables(spark):
    from tributary.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:") + "/staged"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_rounds_leave_one_table_each(spark):
    chain = edges_of(spark, {"r": {(f"n{i + 1:02d}", f"n{i:02d}", "calls") for i in range(8)}})
    seeds = spark.createDataFrame([("r", "c", "s", "n00")], "repo string, commit_sha string, seed string, id string")
    before = staged_tables(spark)
    found = impact.blast_radius(chain, seeds, max_depth=20)
    made = staged_tables(spark) - before
    assert len(made) == 1 and found.count() == 9
    marks = spark.createDataFrame([("r", "c", "n00", "high")], NODE + ", issue_severity string")
    entries = spark.createDataFrame([("r", "c", "n08")], NODE)
    risk = impact.entry_points_at_risk(entries, chain, found, marks)
    assert len(staged_tables(spark) - before - made) == 1 and [(r.entry_point, r.risk) for r in risk.collect()] == [("n08", "high")]


def test_at_risk_walk_ends_at_affected_nodes(spark, monkeypatch):
    labels, real = [], impact.stage
    monkeypatch.setattr(impact, "stage", lambda df, label: labels.append(label) or real(df, label))
    chain = edges_of(spark, {"r": {(f"n{i + 1:02d}", f"n{i:02d}", "calls") for i in range(8)}})
    hit = spark.createDataFrame([("r", "c", "s", f"n{i:02d}") for i in range(9)], "repo string, commit_sha string, seed string, id string")
    entries = spark.createDataFrame([("r", "c", "n08")], NODE)
    none = spark.createDataFrame([], NODE + ", issue_severity string")
    assert [(r.entry_point, r.risk) for r in impact.entry_points_at_risk(entries, chain, hit, none).collect()] == [("n08", "medium")]
    assert "risk-1" in labels and not any(label in labels for label in ("risk-2", "risk-3"))


def test_pairs_of_two_types_count_once(spark):
    rows = [("r", "c", "b", "a", t) for t in ("calls", "imports")] + [("r", "c", "c", "b", t) for t in ("calls", "imports", "calls")]
    edges = spark.createDataFrame(rows, EDGE)
    seeds = spark.createDataFrame([("r", "c", "s", "a")], "repo string, commit_sha string, seed string, id string")
    found = impact.blast_radius(edges, seeds)
    assert sorted((r.id, r.depth) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    risk = impact.entry_points_at_risk(spark.createDataFrame([("r", "c", "c")] * 2, NODE), edges, found, spark.createDataFrame([("r", "c", "a", "high")], NODE + ", issue_severity string"))
    assert [(r.entry_point, r.risk) for r in risk.collect()] == [("c", "high")]


def random_graph(seed, n=14, m=26):
    rnd = random.Random(seed)
    return {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", rnd.choice(["calls", "imports", "defines"])) for _ in range(m)}


def edges_of(spark, graphs):
    return spark.createDataFrame([(r, "c", *e) for r, es in graphs.items() for e in es], EDGE).dropDuplicates(
        ["repo", "source", "target"]
    )


def plain_blast(edges, sources, depth=6):
    back = {}
    for s, t in sorted(edges):
        back.setdefault(t, []).append(s)
    found = {i: (0, [[i]]) for i in sorted(sources)}
    queue = deque(sorted(sources))
    while queue:
        u = queue.popleft()
        d, paths = found[u]
        if d >= depth:
            continue
        for v in sorted(set(back.get(u, []))):
            if v in found:
                if len(found[v][1]) < 3:
                    found[v][1].append(paths[0] + [v])
            else:
                found[v] = (d + 1, [paths[0] + [v]])
                queue.append(v)
    return found


@pytest.mark.parametrize("chunk", [2, 2_000_000])
def test_blast_radius_and_paths(spark, chunk):
    graphs = {"a": random_graph(1), "b": random_graph(2), "chain": {(f"n{i + 1}", f"n{i}", "calls") for i in range(9)} | {("n0", "n0", "calls")}}
    edges = edges_of(spark, graphs).cache()
    changes = {"s1": ["n0"], "s2": ["n3", "n5"]}
    seeds = spark.createDataFrame(
        [(r, "c", s, i) for r in graphs for s, ids in changes.items() for i in ids], "repo string, commit_sha string, seed string, id string"
    )
    affected = impact.blast_radius(edges, seeds, paths=True, rows_per_chunk=chunk)
    got = {(r.repo, r.seed, r.id): r for r in affected.collect()}
    routes = {}
    for r in impact.witness_paths(edges, affected, rows_per_chunk=chunk).orderBy("rank").collect():
        routes.setdefault((r.repo, r.seed, r.id), []).append(r.path)
    pairs = {r: {(e.source, e.target) for e in edges.filter(f"repo = '{r}'").collect()} for r in graphs}
    want = {(r, s, i): v for r in graphs for s, ids in changes.items() for i, v in plain_blast(pairs[r], ids).items()}
    assert {k: v.depth for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert routes == {k: v[1] for k, v in want.items()}
    assert max(r.depth for r in got.values()) <= 6
    named = {0: "source", 1: "critical", 2: "high", 3: "medium", 4: "medium", 5: "low", 6: "low"}
    assert all(r.severity == named[r.depth] for r in got.values())
    totals = {(r.repo, r.seed): r.total for r in impact.impact_totals(affected).collect()}
    assert totals[("chain", "s1")] == 6
    zero = {(r.severity): r.nodes for r in impact.impact_by_severity(affected).filter("repo = 'chain' AND seed = 's1'").collect()}
    assert zero == {"critical": 1, "high": 1, "medium": 2, "low": 2}


@pytest.mark.parametrize("chunk", [2, 2_000_000])
def test_entry_points_at_risk(spark, chunk):
    graphs = {f"g{k}": random_graph(k) for k in range(8)}
    graphs["loop"] = {("e", "x", "calls"), ("x", "e", "calls"), ("p", "e", "calls")}
    edges = edges_of(spark, graphs).cache()
    stored = {r: {(e.source, e.target) for e in edges.filter(f"repo = '{r}' AND type <> 'defines'").collect()} for r in graphs}
    entries, affected, high = {}, {}, {}
    for r in graphs:
        rnd = random.Random(r)
        ids = sorted({i for s, t, _ in graphs[r] for i in (s, t)})
        entries[r], affected[r] = set(rnd.sample(ids, min(6, len(ids)))), set(rnd.sample(ids, min(3, len(ids))))
        high[r] = set(rnd.sample(ids, 2))
    entries["loop"], affected["loop"], high["loop"] = {"e", "x", "p"}, {"e"}, {"e"}
    ent = spark.createDataFrame([(r, "c", i) for r in graphs for i in entries[r]], NODE)
    aff = spark.createDataFrame([(r, "c", "s", i) for r in graphs for i in affected[r]], "repo string, commit_sha string, seed string, id string")
    sev = spark.createDataFrame([(r, "c", i, "high") for r in graphs for i in high[r]], NODE + ", issue_severity string")
    want, listed = {}, set()
    for r in graphs:
        for e in entries[r]:
            seen, queue = set(), [e]
            while queue:
                u = queue.pop()
                if u not in seen:
                    seen.add(u)
                    queue += [t for s, t in stored[r] if s == u]
            hits = {i for i in seen & affected[r] if i != e}
            listed |= {(r, e, i) for i in hits}
            if hits:
                want[(r, e)] = "high" if hits & high[r] else "medium"
    got = impact.entry_points_at_risk(ent, edges, aff, sev, rows_per_chunk=chunk).collect()
    assert {(x.repo, x.entry_point): x.risk for x in got} == want
    assert ("loop", "e") not in want and want[("loop", "p")] == "high"
    pairs = impact.affected_by_entry(ent, edges, aff, rows_per_chunk=chunk).collect()
    assert {(x.repo, x.entry_point, x.id) for x in pairs} == listed


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("chunk", [2, 2_000_000])
def test_walk_keeps_the_first_routes(spark, monkeypatch, chunk):
    labels, real = [], impact.stage
    monkeypatch.setattr(impact, "stage", lambda df, label: labels.append(label) or real(df, label))
    graphs = {"a": random_graph(3), "b": random_graph(4), "loop": {("x", "s", "calls"), ("s", "x", "calls"), ("s", "s", "calls"), ("t", "t", "calls")}}
    # many nodes at once, then few: the known rows are searched for what arrives
    graphs["fan"] = {(f"f{i:02d}", "s", "calls") for i in range(40)} | {("z1", "f07", "calls"), ("z2", "z1", "calls"), ("f03", "z2", "calls"), ("z3", "f03", "calls")}
    # "x" is reached at once, over two more ways in the next round and over others two rounds later
    graphs["late"] = {("x", "s", "calls"), *((m, "s", "calls") for m in "ab"), ("x", "a", "calls"), ("x", "b", "imports"), ("c", "a", "calls"), ("x", "c", "calls")}
    edges = spark.createDataFrame([(r, "c", *e) for r, es in graphs.items() for e in [*es, *sorted(es)[:3]]], EDGE).cache()
    seeds = spark.createDataFrame(
        [(r, "c", k, i) for r in graphs for k, ids in (("k1", ["n0", "s"]), ("k2", ["n3", "n5", "s", "t"])) for i in ids] + [("a", "c", "k1", "n0")],
        "repo string, commit_sha string, seed string, id string",
    )
    plain = impact.blast_radius(edges, seeds, paths=True, rows_per_chunk=chunk)
    kept = impact.blast_radius(edges, seeds, paths=True, rows_per_chunk=chunk, routes=3)
    assert any("arrived" in label for label in labels) == (chunk == 2)
    first = kept.filter("rank = 1").drop("rank")
    assert rows_of(first.select(plain.columns)) == rows_of(plain)
    wanted = impact.witness_paths(edges, plain, rows_per_chunk=chunk)
    got = impact.witness_paths(edges, kept, rows_per_chunk=chunk)
    assert got.columns == wanted.columns and rows_of(got) == rows_of(wanted)
    late = got.filter("repo = 'late' AND seed = 'k1' AND id = 'x'").orderBy("rank").collect()
    assert [r.path for r in late] == [["s", "x"], ["s", "a", "x"], ["s", "b", "x"]]
    shorter = impact.witness_paths(edges, kept, limit=2)
    assert rows_of(shorter) == rows_of(impact.witness_paths(edges, plain, limit=2, rows_per_chunk=chunk))


def test_routes_need_plain_steps(spark):
    from tributary.operators.graph import CallHubs

    edges = edges_of(spark, {"r": {("b", "a", "imports")}})
    named = spark.createDataFrame([("r", "c", "b", "f")], "repo string, commit_sha string, source string, name string")
    index = spark.createDataFrame([("r", "c", "f", "a")], "repo string, commit_sha string, name string, id string")
    seeds = spark.createDataFrame([("r", "c", "s", "a")], "repo string, commit_sha string, seed string, id string")
    with pytest.raises(ValueError, match="plain steps"):
        impact.blast_radius(edges, seeds, hubs=CallHubs(edges, named, index), routes=3)


def test_staging_leaves_no_shuffle_files(spark):
    import time

    from tributary.session import stage

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def held():
        return {n for n in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(conf, None), held()
    out = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "sums")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert spark.conf.get(conf, None) == was and out.count() == 100


def test_at_risk_marks_only_nodes_that_steps_lead_back_from(spark, monkeypatch):
    sizes, real = {}, impact.stage

    def staged(df, label):
        out = real(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(impact, "stage", staged)
    edges = edges_of(spark, {"r": {("e", "a", "calls"), ("p", "e", "calls")} | {("p", f"d{i}", "defines") for i in range(30)}})
    hit = spark.createDataFrame([("r", "c", "s", i) for i in ["a", "e", "p", *[f"d{i}" for i in range(30)]]], "repo string, commit_sha string, seed string, id string")
    entries = spark.createDataFrame([("r", "c", "p")], NODE)
    high = spark.createDataFrame([("r", "c", "a", "high")], NODE + ", issue_severity string")
    risk = impact.entry_points_at_risk(entries, edges, hit, high)
    assert [(r.entry_point, r.risk) for r in risk.collect()] == [("p", "high")]
    assert sizes["risk-0"] == 2


def test_neighbourhood_of_some_nodes(spark):
    nodes = spark.createDataFrame([("r", "c", i, f"{i[0]}.py") for i in ("a", "b", "x", "y")] + [("r", "c", "f.py", "f.py")], NODE + ", file string")
    calls = [("r", "c", f"k{i:02d}", t, "calls") for i in range(9) for t in ("a", "b")] + [("r", "c", "a", t, "calls") for t in ("x", "y", None)]
    imports = [("r", "c", f"m{i}", t, "imports") for i in range(7) for t in ("a.py", "x.py", "f.py")]
    edges = spark.createDataFrame(calls + calls + imports, EDGE)
    every = impact.neighbourhood(nodes, edges)
    by_id = {r.id: r for r in every.collect()}
    assert by_id["a"].callers == [f"k{i:02d}" for i in range(5)] and by_id["a"].callees == ["x", "y"]
    assert by_id["x"].importers == [f"m{i}" for i in range(5)]
    some = impact.neighbourhood(nodes, edges, of=spark.createDataFrame([("r", "c", "a"), ("r", "c", "x"), ("r", "c", "a"), ("r", "c", "none")], NODE))
    assert rows_of(some) == rows_of(every.filter("id IN ('a', 'x')"))


def test_listed_pairs_take_only_affected_nodes_that_are_met(spark, monkeypatch):
    sizes, real = {}, impact.stage

    def staged(df, label):
        out = real(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(impact, "stage", staged)
    edges = edges_of(spark, {"r": {("e", "a", "calls"), ("p", "e", "calls")} | {("p", f"d{i}", "defines") for i in range(30)}})
    rows = [("r", "c", s, i) for s in ("s", "t") for i in ["a", "p", *[f"d{i}" for i in range(30)]]]
    hit = spark.createDataFrame(rows + rows[:2], "repo string, commit_sha string, seed string, id string")
    pairs = impact.affected_by_entry(spark.createDataFrame([("r", "c", "p")], NODE), edges.unionByName(edges), hit)
    assert sorted((r.seed, r.entry_point, r.id) for r in pairs.collect()) == [("s", "p", "a"), ("t", "p", "a")]
    assert sizes["met-affected"] == 2


def test_risk_level(spark):
    rows = [("RISK_LEVEL: risky",), ("text\nrisk_level:DANGEROUS and more",), ("none",), ("RISK_LEVEL: maybe",), (None,)]
    got = impact.risk_level(spark.createDataFrame(rows, "response string")).collect()
    assert [r.risk_level for r in got] == ["RISKY", "DANGEROUS", "CAUTION", "CAUTION", "CAUTION"]


def test_edge_impact(spark):
    edges = spark.createDataFrame([("r", "c", "a", "b", "calls"), ("r", "c", "s", "b", "calls"), ("r", "c", "b", "z", "calls"), ("r", "c", "y", "z", "calls")], EDGE)
    hit = spark.createDataFrame([("r", "c", "a", "critical"), ("r", "c", "b", "low"), ("r", "c", "s", "source")], NODE + ", severity string")
    got = {(r.source, r.target): r.impact for r in impact.edge_impact(edges, hit).collect()}
    assert got == {("a", "b"): "critical", ("s", "b"): "medium", ("b", "z"): "dim", ("y", "z"): "hidden"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_every_supplier_has_a_prompt(spark):
    from tributary.plans.queries import QUERIES, forget_staged, table

    forget_staged()
    parts = QUERIES["impact_prompt_parts_by_supplier"](spark, "/root/testdata/sf0.01").filter("part = 1").select("seed").collect()
    assert sorted(r.seed for r in parts) == sorted(f"S{r.s_suppkey}" for r in table(spark, "/root/testdata/sf0.01", "supplier").collect())
    forget_staged()
