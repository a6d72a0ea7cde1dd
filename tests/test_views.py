import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import conversations, explore, hull, rules, summaries

NODE = "repo string, commit_sha string, id string, label string, type string, file string, summary string, start_line int, end_line int, is_entry_point boolean"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("r", "c", "a.py", "a.py", "file", "a.py", "", None, None, False),
        ("r", "c", "a.py::K", "K", "class", "a.py", "Keeps.", 3, 9, False),
        ("r", "c", "a.py::f", "f", "function", "a.py", "", 4, 5, True),
        ("r", "c", "a.py::g", "g", "function", "a.py", "", 10, 12, False),
        ("r", "c", "lib/x/b.py", "lib/x/b.py", "file", "lib/x/b.py", "", None, None, False),
        ("r", "c", "lib/x/b.py::f", "f", "function", "lib/x/b.py", "", 1, 2, False),
        ("r", "c", "lib/c.py", "lib/c.py", "file", "lib/c.py", "", None, None, False),
        ("r", "c", "z.py", "z.py", "file", "z.py", "", None, None, False),
    ]
    return spark.createDataFrame(rows, NODE)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        ("r", "c", "a.py", "a.py::K", "defines"), ("r", "c", "a.py::f", "a.py::g", "calls"),
        ("r", "c", "a.py::f", "lib/x/b.py::f", "calls"), ("r", "c", "gone", "a.py::f", "calls"), ("r", "c", "a.py", "z.py", "imports"),
    ]
    return spark.createDataFrame(rows, "repo string, commit_sha string, source string, target string, type string")


def test_tree(nodes):
    tree = {r.path: r for r in explore.directory_tree(nodes).collect()}
    assert set(tree) == {"a.py", "lib", "lib/x", "lib/x/b.py", "lib/c.py", "z.py"}
    assert (tree["lib"].files, tree["lib"].functions, tree["lib"].is_file) == (2, 1, False)
    assert (tree["a.py"].functions, tree["a.py"].classes, tree["lib/x"].parent) == (2, 1, "lib")
    ordered = [r.path for r in explore.listing_order(explore.directory_tree(nodes)).collect()]
    assert ordered == ["lib", "a.py", "z.py", "lib/x", "lib/c.py", "lib/x/b.py"]
    hit = {r.path for r in explore.search_tree(explore.directory_tree(nodes), "X/B").collect()}
    assert hit == {"lib", "lib/x", "lib/x/b.py"}
    groups = {r.dir: r.nodes for r in explore.directory_groups(nodes).collect()}
    assert groups == {"__root__": 5, "lib": 3}
    first = explore.first_directories(explore.directory_groups(nodes), limit=1).collect()
    assert [(r.dir, r.more) for r in first] == [("__root__", 1)]


def test_lookups(nodes, edges):
    assert [r.id for r in explore.search_nodes(nodes, "LIB/X").collect()] == ["lib/x/b.py", "lib/x/b.py::f"]
    two = nodes.unionByName(nodes.withColumn("repo", F.lit("other")))
    assert [(r.repo, r.id) for r in explore.search_nodes(two, "LIB/X", limit=1).orderBy("repo").collect()][0] == ("other", "lib/x/b.py")
    assert explore.search_nodes(two, "LIB/X", limit=1).count() == 2
    near = {(r.id, r.direction, r.other, r.hidden) for r in explore.call_neighbours(nodes, edges, limit=1).collect()}
    assert near == {("a.py::f", "callee", "a.py::g", 1), ("a.py::g", "caller", "a.py::f", 0), ("lib/x/b.py::f", "caller", "a.py::f", 0)}
    deg = {r.id: (r.in_degree, r.out_degree) for r in explore.degrees(nodes, edges).collect()}
    assert deg["a.py::f"] == (1, 2) and deg["lib/c.py"] == (0, 0) and "gone" not in deg
    called = {(r.file, r.line, r.callee) for r in explore.calls_by_definition(nodes, edges).collect()}
    assert called == {("a.py", 4, "g"), ("a.py", 4, "f")}
    of_file = {(r.file, r.source) for r in explore.file_edges(nodes, edges).collect()}
    assert of_file == {("a.py", "a.py"), ("a.py", "a.py::f")}
    chosen = nodes.filter("id = 'z.py'")
    assert [r.type for r in explore.incident_edges(edges, chosen).collect()] == ["imports"]
    assert explore.incident_edges(edges, None).count() == 5


def test_weights(nodes):
    ranked = nodes.withColumn("centrality", F.when(F.col("id") == "a.py", 0.5).otherwise(0.0))
    w = {r.id: r.weight for r in explore.node_weights(ranked).collect()}
    assert (w["a.py"], w["a.py::K"], w["a.py::f"], w["a.py::g"]) == (20.0, 5.0, 4.5, 3.0)
    hit = nodes.sparkSession.createDataFrame([("r", "c", "a.py", 0), ("r", "c", "a.py::g", 3)], "repo string, commit_sha string, id string, depth int")
    s = {r.id: r.weight for r in explore.node_weights(ranked, hit).collect()}
    assert s["a.py"] == pytest.approx(36.0) and s["a.py::g"] == pytest.approx(3 * 1.25) and s["a.py::K"] == pytest.approx(2.0)


def test_annotations(spark, nodes):
    text = "import os\n\nclass K:\n    def f(self):\n        pass\n\n\n\n    x = 1\ndef g():\n    pass\n    from_here = 2"
    files = spark.createDataFrame([("r", "c", "a.py", text)], "repo string, commit_sha string, path string, content string")
    rows = explore.annotate_lines(rules.lines(files), nodes, nodes.filter("id = 'a.py::K'")).orderBy("line").collect()
    assert [r.line for r in rows if r.is_import] == [1]
    assert [r.line for r in rows if r.is_def] == [3, 4, 10] and [r.line for r in rows if r.is_class] == [3]
    assert [r.line for r in rows if r.is_highlighted] == [3, 4, 5, 6, 7, 8, 9, 10]
    totals = explore.file_totals(files, nodes).first()
    assert (totals.lines, totals.functions, totals.classes) == (12, 2, 1)


def test_annotation_sweeps_files_without_their_text(spark, tmp_path):
    node = "repo string, commit_sha string, id string, file string, type string, start_line int, end_line int"
    line = "repo string, commit_sha string, path string, line int, text string"
    rnd = random.Random(6)
    nodes, texts = [], []
    for f in ("a", "b"):
        for i in range(40):
            start = rnd.randrange(1, 190)
            nodes.append(("r", "c", f"{f}{i}", f, rnd.choice(["class", "function"]), start, rnd.choice([start, start + 5, start + 40])))
        texts += [("r", "c", f, n, rnd.choice(["import x", "  from y", "x = 1", "imported", ""])) for n in range(1, 201)]
    texts += [("r", "c", "none", 1, "import z"), ("r", "c", "none", 2, None), ("r", "c", "a", None, "x")]
    nodes += [("r", "c", "open", "a", "function", 199, None), ("r", "c", "file", "a", "file", None, None)]
    spark.createDataFrame(texts, line).write.parquet(str(tmp_path / "lines"))
    frame, chosen = spark.createDataFrame(nodes, node), {n[2] for n in nodes[::3]}
    picked = frame.filter(F.col("id").isin(*chosen))
    out = explore.annotate_lines(spark.read.parquet(str(tmp_path / "lines")), frame, picked)
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        mine = [n for n in nodes if n[3] == r.path and n[5] is not None and r.line is not None]
        starts = [n for n in mine if n[5] == r.line]
        inside = [n for n in mine if n[2] in chosen and n[5] <= r.line and (n[6] is None or r.line <= n[6])]
        assert (r.is_def, r.is_class) == (bool(starts), any(n[4] == "class" for n in starts)), r
        assert r.is_highlighted == bool(starts or inside), r
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [part for part in plan.split("\n\n") if " Exchange" in part.split("\n")[0]]
    assert moved and not any("text#" in part for part in moved)


def test_hulls(spark):
    rnd = random.Random(3)
    points = [("g", rnd.random(), rnd.random()) for _ in range(500)] + [("two", 0.0, 0.0), ("two", 1.0, 1.0), ("one", 5.0, 5.0)]
    points += [("line", float(i), float(i)) for i in range(5)] + [("bad", float("nan"), 1.0), ("bad", 1.0, 1.0)]
    df = spark.createDataFrame(points, "k string, x double, y double").repartition(5)
    got = {}
    for r in hull.hulls(df, ["k"], buckets=3).orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    assert got["two"] == [(0.0, 0.0), (1.0, 1.0)] and "one" not in got and "bad" not in got
    assert got["line"] == [(0.0, 0.0), (4.0, 4.0)]
    h = got["g"]
    for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for k, x, y in points if k == "g")
    square = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])], "k string, seq int, x double, y double")
    out = [(round(r.x, 6), round(r.y, 6)) for r in hull.expand(square, ["k"], padding=2 ** 0.5).orderBy("seq").collect()]
    assert out == [(-1, -1), (3, -1), (3, 3), (-1, 3)]


def test_hulls_return_points_that_are_not_finite(spark):
    points = [("g", 0.0, 0.0), ("g", float("nan"), 1.0), ("g", 1.0, float("inf")), ("g", None, 2.0), (None, -float("inf"), 0.0)]
    df = spark.createDataFrame(points, "k string, px double, py double")
    got = [(r.k, str(r.x), str(r.y)) for r in hull.rejected(df, ["k"], "px", "py").collect()]
    assert sorted(got, key=str) == sorted([("g", "nan", "1.0"), ("g", "1.0", "inf"), ("g", "None", "2.0"), (None, "-inf", "0.0")], key=str)


def test_summaries(spark, nodes):
    items = summaries.first_items(summaries.symbols_by_file(nodes), limit=2)
    assert [r.id for r in items.filter("file = 'a.py'").orderBy("rank").collect()] == ["a.py::K", "a.py::f"]
    rich = items.withColumns({"parameters": F.array(F.lit("p")), "docstring": F.lit("")})
    prompt = summaries.prompts(rich).filter("file = 'a.py'").first()
    assert prompt.items == 2 and '[{"name":"K","type":"class","start_line":3,"parameters":["p"]}' in prompt.prompt
    long = " ".join(["word"] * 50)
    answers = [
        ("plain", '{"f": "Does it.", "K": "Keeps it."}'),
        ("fenced", '```json\n{"f": "Fenced."}\n```'),
        ("bare", '```\n{"f": "Bare."}```'),
        ("broken", "not json"),
        ("array", '["f"]'),
        ("mixed", '{"f": 1, "g": null, "h": ["x"], "i": {"j": "k"}, "ok": "yes"}'),
        ("long", '{"f": "%s"}' % long),
        ("odd", '{"it\'s [a] \\"key\\"": "quoted"}'),
        ("empty", ""),
        ("null", None),
    ]
    df = spark.createDataFrame(answers, "file string, response string")
    got = {}
    for r in summaries.parse_responses(df, ("file",)).collect():
        got.setdefault(r.file, {})[r.name] = r.summary
    assert got == {
        "plain": {"f": "Does it.", "K": "Keeps it."},
        "fenced": {"f": "Fenced."},
        "bare": {"f": "Bare."},
        "mixed": {"ok": "yes"},
        "long": {"f": " ".join(["word"] * 30) + " ..."},
        "odd": {'it\'s [a] "key"': "quoted"},
    }
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    first = spark.createDataFrame([("a", "1"), ("b", None)], "file string, response string")
    second = spark.createDataFrame([("a", "2"), ("b", "2")], "file string, response string")
    assert {r.file: r.response for r in summaries.with_fallback(files, first, second, ("file",)).collect()} == {"a": "1", "b": "2", "c": None}
    new = spark.createDataFrame([("r", "c", "a.py", "f", "New."), ("r", "c", "a.py", "a.py", "No.")], "repo string, commit_sha string, file string, name string, summary string")
    merged = {r.id: r.summary for r in summaries.merge_summaries(nodes, new).collect()}
    assert merged["a.py::f"] == "New." and merged["a.py::K"] == "Keeps." and merged["a.py"] == "" and merged["lib/x/b.py::f"] == ""


def test_conversations(spark, nodes, edges):
    lines = conversations.outline_lines(nodes, limit=2)
    text = {r.file: r.text for r in conversations.outline_text(lines).collect()}
    assert text == {"a.py": "  a.py\n    class K — Keeps.\n    def f\n    def g", "lib/c.py": "  lib/c.py"}
    assert [r.line for r in conversations.entry_context(nodes).collect()] == ["  a.py::f: "]
    assert [r.line for r in conversations.call_context(edges, 2).orderBy("rank").collect()] == ["  a.py::f → a.py::g", "  a.py::f → lib/x/b.py::f"]
    asked = [r.question for r in conversations.suggestions(nodes).orderBy("rank").collect()]
    assert asked[2:] == ["What does `f` do and what calls it?", "How does `a.py` relate to `c.py`?"]
    answer = "Use `a.py::f` and `K`.\nNODE: not here\nReferences:\n NODE: a.py::f\nNODE:a.py\nNODE: nope\nnode: z.py `a.py::g`"
    rows = spark.createDataFrame([("r", "c", 1, answer)], "repo string, commit_sha string, n int, answer string")
    listed = conversations.answer_references(rows, nodes, ["n"]).orderBy("ordinal").collect()
    assert [r.id for r in listed] == ["a.py::f", "a.py"]
    assert [r.id for r in conversations.inline_references(rows, nodes, ["n"]).collect()] == ["a.py::f"]
    by_label = conversations.inline_references(rows, nodes, ["n"], by_label=True).orderBy("ordinal").collect()
    assert [r.id for r in by_label] == ["a.py::f", "a.py::K", "a.py::g"]
    turns = spark.createDataFrame([(1, t) for t in range(9)] + [(2, 0)], "conv_id long, turn long")
    kept = {(r.conv_id, r.turn) for r in conversations.last_messages(turns).collect()}
    assert kept == {(1, t) for t in range(3, 9)} | {(2, 0)}
