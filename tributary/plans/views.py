"""Shared inputs for queries and checks, as SQL text both engines accept.

``CORPUS`` turns every document into one source file, the document's whole
text included as comment lines, so work grows with the tables.  A third of all
files lands in one repository.  ``GRAPH_*`` reads the trade tables as a
dependency graph.  ``LINES`` splits every document into lines.
"""

from __future__ import annotations

_NL = "chr(10)"


def _id(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def path_of(n: str) -> str:
    """Path of the file made from document ``n``."""
    return (
        f"CASE WHEN {n} % 20 = 3 THEN concat('m', {n}, '.py') "
        f"WHEN {n} % 30 = 7 THEN concat('pkg', {n} % 7, '/test_m', {n}, '.py') "
        f"WHEN {n} % 50 = 49 THEN concat('pkg', {n} % 7, '/m', {n}, '/__init__.py') "
        f"ELSE concat('pkg', {n} % 7, '/sub', {n} % 3, '/m', {n}, '.py') END"
    )


def module_of(n: str) -> str:
    p = path_of(n)
    return f"replace(substr({p}, 1, length({p}) - 3), '/', '.')"


def _text(line: str) -> str:
    """A template line: ``{expr}`` parts are SQL over ``n``."""
    parts, rest = [], line
    while "{" in rest:
        before, rest = rest.split("{", 1)
        expr, rest = rest.split("}", 1)
        if before:
            parts.append("'" + before.replace("'", "''") + "'")
        parts.append(expr)
    if rest:
        parts.append("'" + rest.replace("'", "''") + "'")
    return "concat(" + ", ".join(parts + [_NL]) + ")"


_M = "{module_next}"
_TEMPLATE: list[tuple[str | None, list[str]]] = [
    (None, ["import os", "import sys, {nxt} as nxt"]),
    ("n % 10 = 2", ["from {prv} import helper_{n - 1}, other as o"]),
    ("n % 9 = 4", ["from .sibling import (", "    alpha as a,", "    beta,", ")"]),
    (None, ["LIMIT = 10"]),
    ("n % 13 = 0", ['password = "hunter2hunter2"']),
    ("n % 13 = 1", ['api_key = "your_example_key"']),
    ("n % 13 = 2", ["token = 'abcdefghijklmnop'"]),
    ("n % 17 = 3", ['aws_secret = "x"']),
    (None, [
        "class Store_{n}(Base, mod.Mixin, metaclass=Meta):",
        '    """Store of module {n}',
        "    over several lines.",
        '    """',
    ]),
    ("n % 12 = 0", ["    _instance = None"]),
    (None, [
        "    def get(self, key):",
        "        return self.load_{decade}(key)",
        "",
        "    def save(self, key, value=None):",
        "        self.db.put(key, value)",
        "    @property",
        "    def delete(self):",
        "        pass",
    ]),
    ("n % 7 = 0", [
        "    def __enter__(self):",
        "        return self",
        "    def __exit__(self, *args):",
        "        self.close()",
    ]),
    ("n % 12 = 0", ["    @classmethod", "    def get_instance(cls):", "        return cls()"]),
    ("n % 16 = 0", ["    def create_item(self): pass"]),
    ("n % 25 = 0", [f"    def m{i}(self): pass" for i in range(1, 17)]),
    (None, ["def load_{decade}(key):", "    return key"]),
    (None, ["def helper_{n}(a, b):"]),
    ("n % 2 = 0", ['    """Helps {n}."""']),
    (None, ["    x = helper_{n + 1}(a, b)"]),
    ("n % 11 = 0", ["    # TODO: tidy {n} later", '    v = eval("1")']),
    ("n % 11 = 5", ["    # FIXME"]),
    (None, ["    return Store_{n}(a).find(x)"]),
    ("n % 8 = 1", ["def create_{n}(", "    a: int,", "    b=(1, 2),", "    *args,", '    c="x", d=None, e=0, f=1, g=2,', "):", "    return None"]),
    ("n % 8 = 2", ["def widget_factory(func):", "    def wrap(*args):", "        return func(*args)", "    return wrap"]),
    ("n % 15 = 4", ["def long_{n}():", "{steps}    return 0"]),
    ("n % 21 = 6", ["def query_{n}(cur, x):", '    cur.execute(f"select {x}")']),
    ("n % 21 = 7", ["pdb.set_trace()"]),
    ("n % 21 = 8", ['print("DEBUG", LIMIT)']),
    (None, ["async def run_{n}(job):", "    await job()"]),
    ("n % 6 = 0", ["helper_{n}(1, 2)"]),
]


def _corpus() -> str:
    names = {
        "{nxt}": "{" + module_of("(n + 1)") + "}",
        "{prv}": "{" + module_of("(n - 1)") + "}",
        "{decade}": "{" + _id("floor(n / 10)") + "}",
        "{steps}": "{repeat(concat('    step()', " + _NL + "), 52)}",
        "{x}": "{concat(chr(123), 'x', chr(125))}",
    }
    pieces = [f"concat('# ', replace(text, {_NL}, concat({_NL}, '# ')), {_NL})"]
    for condition, lines in _TEMPLATE:
        texts = []
        for line in lines:
            for key, value in names.items():
                line = line.replace(key, value)
            texts.append(_text(line))
        body = texts[0] if len(texts) == 1 else "concat(" + ", ".join(texts) + ")"
        pieces.append(f"CASE WHEN {condition} THEN {body} ELSE '' END" if condition else body)
    content = "concat(" + ",\n ".join(pieces) + ")"
    block = _id("floor(n / 50)")
    return (
        "SELECT repo, commit_sha, path, content, length(coalesce(content, '')) AS size FROM (\n"
        f" SELECT CASE WHEN {block} % 3 = 0 THEN 'acme/mono' ELSE concat('acme/repo_', {block}) END AS repo,"
        f" 'c0' AS commit_sha, {path_of('n')} AS path,\n"
        f" CASE WHEN n % 97 = 96 THEN NULL WHEN n % 97 = 95 THEN concat('  ', {_NL}) ELSE\n {content} END AS content\n"
        " FROM (SELECT doc_id AS n, text FROM documents) d) f"
    )


#: One source file per document: (repo, commit_sha, path, content, size).
CORPUS = _corpus()

_PATHED = "concat('R', n_regionkey, '/N', n_nationkey)"

#: Nodes of the trade graph: (repo, commit_sha, id, label, type, file).
GRAPH_NODES = f"""
SELECT 'supply' AS repo, 'c0' AS commit_sha, id, label, type, file FROM (
  SELECT concat('R', r_regionkey) AS id, r_name AS label, 'file' AS type, concat('R', r_regionkey) AS file FROM region
  UNION ALL SELECT concat('N', n_nationkey), n_name, 'file', {_PATHED} FROM nation
  UNION ALL SELECT concat('C', c_custkey), c_name, 'class', {_PATHED}
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('O', o_orderkey), concat('order_', o_orderkey), 'function', {_PATHED}
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('S', s_suppkey), s_name, 'function', {_PATHED}
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
) g"""

#: Edges of the trade graph: (repo, commit_sha, source, target, type).
GRAPH_EDGES = """
SELECT 'supply' AS repo, 'c0' AS commit_sha, source, target, type FROM (
  SELECT concat('R', n_regionkey) AS source, concat('N', n_nationkey) AS target, 'defines' AS type FROM nation
  UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), 'defines' FROM customer
  UNION ALL SELECT concat('C', o_custkey), concat('O', o_orderkey), 'imports' FROM orders
  UNION ALL SELECT DISTINCT concat('O', l_orderkey), concat('S', l_suppkey), 'calls' FROM lineitem
) g"""
