import pytest

from tributary.operators import health, rules, structure, symbols
from tributary.plans import analysis

LINE = "repo string, commit_sha string, path string, line int, text string"


def scan(spark, texts, path="a.py"):
    rows = [("r", "c", path, i, t) for i, t in enumerate(texts)]
    return [(r.line, r.severity, r.message) for r in rules.scan(spark.createDataFrame(rows, LINE)).orderBy("line", "rule").collect()]


def test_secrets(spark):
    texts = [
        'password = "abcd"',
        'PASSWD="abc"',
        "api_key = 'longenough'; password = 'x1234'",
        "  # token = 'abcdefghijkl'",
        "token = 'abcdefghijkl'  # example",
        "secret = os.getenv('abcdefgh12')",
        "my_token = 'abcdefghij'",
        'aws_secret = "',
        "secret_key='abcdefgh'",
        "password = '<hidden>'",
    ]
    got = scan(spark, texts)
    say = "Possible hardcoded %s detected"
    assert got == [
        (0, "high", say % "password"),
        (2, "high", say % "password"),
        (6, "high", say % "token"),
        (7, "high", say % "aws_key"),
        (8, "high", say % "secret_key"),
    ]


def test_other_rules(spark):
    texts = [
        'cur.execute(f"select {x}")',
        'cur.execute("a" + b + "c")',
        "# cur.execute(f'x')",
        "medieval(1)",
        "x = eval (y)",
        "breakpoint(); pdb.set_trace()",
        'print("DEBUG it")',
        "x = 1 # todo: tidy this up  ",
        "# FIXME",
        "# hack " + "y" * 80,
    ]
    got = scan(spark, texts)
    assert [g[0] for g in got] == [0, 1, 4, 5, 6, 7, 9]
    assert got[5][2] == "TODO/FIXME comment: tidy this up"
    assert got[6][2] == "TODO/FIXME comment: " + "y" * 60
    assert [g[0] for g in scan(spark, texts, "pkg/tests/a.py")] == [0, 1, 4, 7, 9]


CODE = '''import b
class Shop:
    _instance = None
    def get(self): pass
    def save(self): pass
    def list(self): pass
    def __enter__(self): pass
    def __exit__(self): pass
    def make_factory(self): pass
class WidgetFactory:
    def getInstance(self): pass
def wide(a, b, c, d, e, f, g):
    return 1
def create_it(fn):
    """Doc."""
    return fn
def long():
''' + "    x()\n" * 60 + "def main(): pass\ndef _hidden(): pass\ndef test_x(): pass\npassword = 'abcdef'\n"


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(
        [("r", "c", "a.py", CODE), ("r", "c", "b.py", "import a\n"), ("r", "c", "big.py", "class Big:\n" + "".join(f"    def m{i}(self): pass\n" for i in range(16)))],
        "repo string, commit_sha string, path string, content string",
    )
    s = analysis.read_symbols(files)
    g = analysis.build_graph(s)
    return s, g, analysis.find(s, g)


def test_structure(found):
    s, g, f = found
    issues = {(r.file, r.line, r.message) for r in f.issues.collect()}
    start = CODE.split("\n").index("def long():") + 1
    assert ("a.py", start, "Function long is 60 lines — consider breaking it up") in issues
    assert ("a.py", CODE.split("\n").index("def wide(a, b, c, d, e, f, g):") + 1, "Function wide has 7 parameters — may indicate poor design") in issues
    assert ("big.py", 1, "Class Big has 16 methods — possible God Object anti-pattern") in issues
    assert ("a.py", 1, "Circular import: a.py ↔ b.py") in issues
    assert ("a.py", 1, "4 public functions missing docstrings") in issues  # wide, long, main, test_x
    dead = {m.split()[1] for _, _, m in issues if m.endswith("appears to be unused")}
    assert {"wide", "long", "create_it", "get", "m3"} <= dead
    assert not dead & {"main", "_hidden", "test_x", "__enter__"}
    assert structure.dead_code(g.nodes, g.edges, edge_types=("calls", "imports", "defines")).isEmpty()
    patterns = {(r.name, r["class"]) for r in f.patterns.collect()}
    assert patterns == {
        ("Singleton", "Shop"), ("Singleton", "WidgetFactory"), ("Factory", "WidgetFactory"), ("Factory", "Shop"),
        ("Repository", "Shop"), ("Context Manager", "Shop"), ("Factory", "make_factory"), ("Factory", "create_it"),
        ("Decorator", "create_it"),
    }
    assert f.issues.count() == len(issues)


def test_health(found):
    s, g, f = found
    row = health.health(g.nodes, f.issues, f.patterns).first()
    counts = {r.severity: r.n for r in f.issues.groupBy("severity").count().withColumnRenamed("count", "n").collect()}
    n = {r.type: r["count"] for r in g.nodes.groupBy("type").count().collect()}
    raw = 100 - 8 * counts["high"] - 3 * counts["medium"] - counts["low"] + 2 * f.patterns.count() - 10
    if row.dead_code_count / n["function"] > 0.2:
        raw -= 10
    assert row.score == max(0, min(100, raw))
    assert (row.total_files, row.total_functions, row.total_classes) == (3, n["function"], n["class"])
    assert row.max_function_length == 60 and row.circular_import_count == 1
    assert row.most_complex_file == "big.py"
    halved = health.health(g.nodes, f.issues, f.patterns, circular_divisor=2).first()
    assert halved.circular_import_count == 0 and halved.score in (row.score, min(100, row.score + 5))
    assert 0 <= row.score <= 100 and row.grade in "ABCDF"


def test_rollups(found):
    _, g, f = found
    per_file = health.file_issues(f.issues)
    sev = {r.file: r.severity for r in per_file.collect()}
    assert sev == {"a.py": "high", "big.py": "medium"}
    badges = {r.id: (r.issue_count, r.issue_severity) for r in health.badge_nodes(g.nodes, per_file).collect()}
    assert badges["b.py"] == (0, None) and badges["a.py::wide"][1] == "high"
    low = health.issues_in_files(f.issues, per_file, "low").collect()
    assert {r.file_severity for r in low if r.file == "a.py"} == {"high"}
    ids = {(r.message, r.node_id) for r in health.issue_nodes(f.issues, g.nodes).collect()}
    assert ("Function long appears to be unused", "a.py::long") in ids
    assert ("Possible hardcoded password detected", "a.py") in ids


def test_grades(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(s,) for s in (100, 90, 89, 80, 70, 60, 59, 0)], "s int").select(health.grade(F.col("s")).alias("g")).collect()
    assert "".join(r.g for r in got) == "AABBCDFF"


def test_empty_repository(spark):
    files = spark.createDataFrame([("r", "c", "a.py", "")], "repo string, commit_sha string, path string, content string")
    g, f, h = analysis.analyse(files)
    row = h.first()
    assert (row.score, row.grade, row.total_files, row.avg_function_length, row.most_complex_file) == (100, "A", 1, 0.0, None)
    assert g.nodes.first().centrality == 1.0
