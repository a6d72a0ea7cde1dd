import pytest

from tributary.operators import symbols

SAMPLE = '''
from base import jot, JotError
from .tools import helper
import os, a.b as c
from . import near
from wide import *
from many import (
    one as uno,
    two,
)

@dataclass
class Checker(BaseChecker, mod.Mixin, Generic[T], metaclass=Meta):
    """Checks
    tokens (of a kind).

def not_code(): pass
    """
    limit = 3
    _instance: "Checker" = None

    def __init__(self, secret, *args, size: int = len([1, 2]), **kw):
        self.secret = secret

    @staticmethod
    @app.route("/x", methods=["GET"])
    async def verify(token,
                     other={"a": (1, 2)}):
        # comment (call())
        'Verify.'
        payload = jot.decode(token, self.secret)
        self.db.put(payload); self.load()
        if ok(payload):
            def inner():
                return deep(1).chain(2)
            inner()
        return payload

    if DEBUG:
        def hidden(self):
            pass

x = build(
    other(),
)

def standalone(token, secret=make()):
    r"""Raw doc"""
    return helper(token)
# trailing comment
'''


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [
        ("r", "c", "a.py", SAMPLE),
        ("r", "c", "empty.py", ""),
        ("r", "c", "blank.py", "  \n\n "),
        ("r", "c", "none.py", None),
        ("r", "c", "broken.py", "def foo(\n    class = broken syntax {{{\ndef bar(x):\n    call(x)\n"),
    ]
    df = spark.createDataFrame(rows, "repo string, commit_sha string, path string, content string")
    return symbols.parse_files(df).cache()


def by_name(df, path="a.py"):
    return {r["name"]: r for r in df.filter(f"path = '{path}'").collect()}


def test_functions(parsed):
    f = by_name(symbols.functions(parsed))
    assert set(f) == {"__init__", "verify", "inner", "hidden", "standalone"}
    assert f["__init__"].parameters == ["secret", "size"]
    assert f["__init__"].is_method and f["verify"].is_method
    assert not f["inner"].is_method and not f["hidden"].is_method and not f["standalone"].is_method
    assert f["verify"].decorator_names == ["staticmethod", "app.route"]
    assert f["verify"].parameters == ["token", "other"]
    assert f["verify"].docstring == "Verify."
    assert f["standalone"].docstring == 'r"""Raw doc"""'
    assert f["standalone"].id == "a.py::standalone"
    lines = SAMPLE.split("\n")
    assert lines[f["verify"].start_line - 1].strip().startswith("async def verify")
    assert lines[f["verify"].end_line - 1].strip() == "return payload"
    assert lines[f["standalone"].end_line - 1].strip() == "return helper(token)"
    assert f["inner"].end_line == f["inner"].start_line + 1


def test_classes(parsed):
    c = by_name(symbols.classes(parsed))["Checker"]
    assert c.base_classes == ["BaseChecker", "mod.Mixin"]
    assert c.method_names == ["__init__", "verify"]
    assert c.docstring.startswith("Checks\n    tokens") and c.docstring.endswith("def not_code(): pass")
    assert c.class_variables == ["limit", "_instance"]
    assert SAMPLE.split("\n")[c.end_line - 1].strip() == "pass"


def test_imports(parsed):
    rows = symbols.imports(parsed).filter("path = 'a.py'").orderBy("line", "ordinal").collect()
    got = [(r["module"], r["names"], r["is_relative"]) for r in rows]
    assert got == [
        ("base", ["jot", "JotError"], False),
        ("tools", ["helper"], True),
        ("os", ["os"], False),
        ("a.b", ["a.b"], False),
        ("", ["near"], True),
        ("wide", [], False),
        ("many", ["one", "two"], False),
    ]


def test_calls(parsed):
    got = {(r.caller_function, r.callee) for r in symbols.call_sites(parsed).filter("path = 'a.py'").collect()}
    assert got == {
        ("__init__", "len"),
        ("__module__", "app.route"),
        ("verify", "jot.decode"),
        ("verify", "db.put"),
        ("verify", "load"),
        ("verify", "ok"),
        ("inner", "deep"),
        ("inner", "(...).chain"),
        ("verify", "inner"),
        ("__module__", "build"),
        ("__module__", "other"),
        ("standalone", "make"),
        ("standalone", "helper"),
    }


def test_isolation(parsed):
    assert parsed.count() == 5
    names = {r["name"] for r in symbols.functions(parsed).filter("path <> 'a.py'").collect()}
    assert names == {"foo", "bar"}
    calls = symbols.call_sites(parsed).filter("path = 'broken.py'").collect()
    assert [(c.caller_function, c.callee) for c in calls] == [("bar", "call")]


ODD = '''
"""a module \\""" that
def not_inside(): pass
"""

def deep(a=((((((((1)))))))), b=[[[[[[[{}]]]]]]], c=3):
    """says \\"""hello\\""" """
    return a

def typed[T: list[int], U: dict[str, list[int]]](x, y):
    return x

class Box[T: dict[str, int]](Base):
    pass
'''


def test_escaped_quotes_deep_brackets_and_type_parameters(spark):
    rows = symbols.parse_files(spark.createDataFrame([("r", "c", "odd.py", ODD)], "repo string, commit_sha string, path string, content string"))
    found = {r.name: r for r in symbols.functions(rows).collect()}
    assert set(found) == {"deep", "typed"}
    assert found["deep"].parameters == ["a", "b", "c"] and found["typed"].parameters == ["x", "y"]
    assert found["deep"].docstring.startswith("says") and "hello" in found["deep"].docstring
    (box,) = symbols.classes(rows).collect()
    assert box.name == "Box" and box.base_classes == ["Base"]


def test_calls_in_formatted_strings(spark):
    text = 'def h(x):\n    a = f"v={g(x)} {{no(1)}} {k(\'q(2)\')!r:>9}" + "w={plain(x)}"\n    return rf\'{m.n(a)}\' + F"{x}"\n'
    rows = symbols.parse_files(spark.createDataFrame([("r", "c", "f.py", text)], "repo string, commit_sha string, path string, content string"))
    assert {(r.caller_function, r.callee, r.line) for r in symbols.call_sites(rows).collect()} == {("h", "g", 2), ("h", "k", 2), ("h", "m.n", 3)}


def test_formatted_fields_of_any_depth(spark):
    lines = [
        'f"{compute(x):>{width(y)}}"', 'f"{a(x):{w}} b {b(1)}"', 'f"{g({1: {2: h(3)}})}"', "f'{p(d[\"}\"]):}}>{n}} {q(1)}'",
        "f\"{r(x):'>9} {s(y)}\"", 'f"{{no(1)}} {{{yes(2)}}} {open(3"',
    ]
    text = "def top(x):\n" + "".join(f"    v = {line}\n" for line in lines) + "    return last(1)\n"
    rows = symbols.parse_files(spark.createDataFrame([("r", "c", "f.py", text)], "repo string, commit_sha string, path string, content string"))
    found = {(r.callee, r.line) for r in symbols.call_sites(rows).collect()}
    assert found == {
        ("compute", 2), ("width", 2), ("a", 3), ("b", 3), ("g", 4), ("h", 4), ("p", 5), ("q", 5), ("r", 6), ("s", 6), ("yes", 7), ("last", 8),
    }


def test_type_parameters_of_any_depth(spark):
    text = (
        "def f[T: dict[str, list[tuple[int]]]](x):\n    return g(x)\n\nclass B[T: a[b[c[d[e]]]]](Base):\n    pass\n\n"
        "async def h[\n    T: a[b[c[d]]],\n](y, z):\n    pass\n\nclass C[T: a[b[c[d]]]]:\n    pass\n"
    )
    rows = symbols.parse_files(spark.createDataFrame([("r", "c", "t.py", text)], "repo string, commit_sha string, path string, content string"))
    assert {r.name: r.parameters for r in symbols.functions(rows).collect()} == {"f": ["x"], "h": ["y", "z"]}
    assert {r.name: r.base_classes for r in symbols.classes(rows).collect()} == {"B": ["Base"], "C": []}
    assert {(r.caller_function, r.callee) for r in symbols.call_sites(rows).collect()} == {("f", "g")}


def test_calls_in_formatted_strings_over_several_lines(spark):
    text = (
        'def h(x):\n    a = f"""v={g(x)}\n  {{no(1)}} {k(\n    "q(2)", inner(3),\n  )!r}\n\n{s.t(x):>{width(y)}} end"""\n    return last(a)\n\n'
        "def two(x):\n    return rf'''\n{m.n(x)}{\nopen_one(4)'''\n\nafter(5)\n"
    )
    rows = symbols.parse_files(spark.createDataFrame([("r", "c", "f.py", text)], "repo string, commit_sha string, path string, content string"))
    assert {(r.caller_function, r.callee, r.line) for r in symbols.call_sites(rows).collect()} == {
        ("h", "g", 2), ("h", "k", 3), ("h", "inner", 4), ("h", "s.t", 7), ("h", "width", 7), ("h", "last", 8), ("two", "m.n", 12), ("__module__", "after", 15),
    }
    assert {(r.name, r.start_line, r.end_line) for r in symbols.functions(rows).collect()} == {("h", 1, 8), ("two", 10, 13)}


def test_docstrings_on_the_header_line(spark):
    text = '''
class A: "Short."
class B(Base, meta={"k": ""}): r"Raw."; x = ""
def f(a="x", b: "T" = {1: ""}): "Says f."
def g(a: "x" = ""): return "no"
def h() -> "R": """Over
    two lines."""
def i(): f"{x}"
def j(): ["no"]
async def k(a=("",)): 'Single' ; return ""
def l(): b"bytes"
def m(x):
    "Below."
    return lambda: ""
def n(): ""
'''
    rows = symbols.parse_files(spark.createDataFrame([("r", "c", "d.py", text)], "repo string, commit_sha string, path string, content string"))
    got = {r.name: r.docstring for df in (symbols.functions(rows), symbols.classes(rows)) for r in df.collect()}
    assert got == {
        "A": "Short.", "B": 'r"Raw."', "f": "Says f.", "g": None, "h": "Over\n    two lines.", "i": None, "j": None, "k": "Single", "l": None, "m": "Below.", "n": None,
    }


def test_content_is_cut_into_tokens_once(spark):
    from pyspark.sql import functions as F

    from tributary.functions.text import mask_literals

    masked = spark.createDataFrame([("x = f\"{g(1)}\" + 'a'",)], "content string").select(mask_literals(F.col("content")).alias("m"))
    assert masked._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(content") == 1
    assert masked.collect()[0].m == 'x = f"" % (g(1)) + ""'
