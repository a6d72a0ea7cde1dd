"""The registered queries stated in plain SQL for another engine.

They work from the same tables by other means (joins over lines instead of
array functions, recursive queries instead of loops), so that agreement says
something.  Comments of the corpus start their line, and only triple-quoted
strings span lines; the text relies on that.
"""

from __future__ import annotations

from tributary import schemas as S
from tributary.plans import views

ROUNDS = 10
_K = "repo, commit_sha"


def _with(ctes: list[tuple[str, str]], body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS {'' if n.startswith('r_') else 'MATERIALIZED '}({t})" for n, t in ctes) + "\n" + body


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


# --- Corpus ------------------------------------------------------------------

_VC = [("vc", views.CORPUS)]

_RAW = _VC + [
    (
        "raw",
        f"""SELECT {_K}, path, unnest(string_split(content, chr(10))) AS text,
 unnest(generate_series(1, len(string_split(content, chr(10))))) AS line
 FROM vc WHERE regexp_matches(content, '\\S')""",
    ),
]

_LINES = _VC + [
    (
        "clean",
        f"""SELECT {_K}, path, content, string_split(content, chr(10)) AS raws,
 string_split(array_to_string(list_transform(string_split(regexp_replace(content, '(?m)^ *#[^\\n]*', '', 'g'), '\"\"\"'),
   lambda s, i: CASE WHEN i % 2 = 0 THEN concat('\"\"', regexp_replace(s, '[^\\n]', '', 'g')) ELSE s END), ''), chr(10)) AS masked
 FROM vc WHERE regexp_matches(content, '\\S')""",
    ),
    (
        "ln",
        f"""SELECT * FROM (SELECT {_K}, path, unnest(masked) AS text, unnest(generate_series(1, len(masked))) AS line FROM clean)
 WHERE trim(text) <> ''""",
    ),
    (
        "dep",
        f"""SELECT *, length(text) - length(ltrim(text)) AS indent,
 coalesce(sum(length(regexp_replace(text, '[)\\]}}]', '', 'g')) - length(regexp_replace(text, '[(\\[{{]', '', 'g')))
 OVER (PARTITION BY {_K}, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM ln""",
    ),
    (
        "num",
        f"SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {_K}, path ORDER BY line) AS no FROM dep",
    ),
    (
        "st0",
        f"""SELECT {_K}, path, no, min(line) AS s, max(line) AS e, arg_min(indent, line) AS indent,
 string_agg(trim(text), ' ' ORDER BY line) AS text FROM num GROUP BY {_K}, path, no""",
    ),
    (
        "st",
        f"""SELECT *, CASE WHEN regexp_matches(text, '^(async +)?def +\\w+') THEN 'def'
 WHEN regexp_matches(text, '^class +\\w+') THEN 'class' WHEN text LIKE '@%' THEN 'decorator' ELSE 'other' END AS kind,
 regexp_extract(text, '^(?:(?:async +)?def|class) +(\\w+)', 1) AS name,
 lag(text) OVER (PARTITION BY {_K}, path ORDER BY s) AS prev_text,
 lead(text) OVER (PARTITION BY {_K}, path ORDER BY s) AS next_text,
 lead(s) OVER (PARTITION BY {_K}, path ORDER BY s) AS next_s FROM st0""",
    ),
    (
        "hd",
        f"""SELECT h.repo, h.commit_sha, h.path, h.s, h.indent, h.kind, h.name, h.text, h.prev_text, h.next_text, h.next_s,
 (SELECT max(b.e) FROM st b WHERE b.repo = h.repo AND b.path = h.path AND b.s >= h.s AND b.s < h.stop) AS block_end
 FROM (SELECT a.*, coalesce(min(b.s), 1000000000) AS stop FROM st a LEFT JOIN st b
   ON a.repo = b.repo AND a.path = b.path AND b.s > a.s AND b.indent <= a.indent
   WHERE a.kind IN ('def', 'class') GROUP BY ALL) h""",
    ),
    (
        "par",
        """SELECT x.repo, x.path, x.s, arg_max(h.kind, h.s) AS parent_kind, max(h.s) AS parent
 FROM st x JOIN hd h ON x.repo = h.repo AND x.path = h.path AND x.s > h.s AND x.s <= h.block_end GROUP BY x.repo, x.path, x.s""",
    ),
    (
        "doc",
        f"""SELECT h.repo, h.path, h.s, nullif(trim(regexp_extract(array_to_string(list_slice(c.raws, h.next_s, h.next_s + 3), chr(10)),
   '(?s)^\\s*\"\"\"(.*?)\"\"\"', 1), chr(10) || ' '), '') AS docstring
 FROM hd h JOIN clean c ON h.repo = c.repo AND h.path = c.path WHERE h.next_text = '\"\"'""",
    ),
    (
        "fn",
        f"""SELECT h.repo, h.commit_sha, h.path, concat(h.path, '::', h.name) AS id, h.name, h.s AS start_line, h.block_end AS end_line,
 list_filter(list_transform(string_split(regexp_replace(regexp_extract(h.text, 'def +\\w+ *\\((.*)\\) *:', 1), '\\([^()]*\\)', '', 'g'), ','),
   lambda p: regexp_extract(p, '^ *([A-Za-z_]\\w*)', 1)), lambda p: p NOT IN ('', 'self', 'cls')) AS parameters,
 coalesce(p.parent_kind = 'class', false) AS is_method,
 CASE WHEN h.prev_text LIKE '@%' THEN regexp_extract(h.prev_text, '^@([\\w.]+)', 1) ELSE '' END AS decorator_names,
 d.docstring, p.parent
 FROM hd h LEFT JOIN par p ON h.repo = p.repo AND h.path = p.path AND h.s = p.s
 LEFT JOIN doc d ON h.repo = d.repo AND h.path = d.path AND h.s = d.s WHERE h.kind = 'def'""",
    ),
    (
        "cl",
        f"""SELECT h.repo, h.commit_sha, h.path, concat(h.path, '::', h.name) AS id, h.name, h.s AS start_line, h.block_end AS end_line,
 array_to_string(list_filter(list_transform(string_split(regexp_extract(h.text, 'class +\\w+ *\\((.*)\\) *:', 1), ','), lambda b: trim(b)),
   lambda b: regexp_matches(b, '^[A-Za-z_][\\w.]*$')), ',') AS base_classes,
 coalesce((SELECT list(f.name ORDER BY f.start_line) FROM fn f WHERE f.repo = h.repo AND f.path = h.path AND f.parent = h.s), []) AS methods,
 coalesce((SELECT string_agg(regexp_extract(x.text, '^(\\w+) *=', 1), ',' ORDER BY x.s) FROM st x JOIN par p ON x.repo = p.repo AND x.path = p.path AND x.s = p.s
   WHERE x.repo = h.repo AND x.path = h.path AND p.parent = h.s AND regexp_matches(x.text, '^\\w+ *=')), '') AS class_variables,
 d.docstring FROM hd h LEFT JOIN doc d ON h.repo = d.repo AND h.path = d.path AND h.s = d.s WHERE h.kind = 'class'""",
    ),
    (
        "im",
        f"""SELECT {_K}, path, s AS line, regexp_extract(trim(m), '^([\\w.]+)', 1) AS module, regexp_extract(trim(m), '^([\\w.]+)', 1) AS names, false AS is_relative
 FROM (SELECT {_K}, path, s, unnest(string_split(substr(text, 8), ',')) AS m FROM st WHERE text LIKE 'import %')
 UNION ALL SELECT {_K}, path, s, regexp_extract(text, '^from +\\.*([\\w.]*) +import', 1),
 array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_extract(text, ' import +(.*)$', 1), '[()]', ' ', 'g'), ','),
   lambda m: regexp_extract(m, '^ *([\\w.]+)', 1)), lambda m: m <> ''), ','), text LIKE 'from .%' FROM st WHERE text LIKE 'from %'""",
    ),
    (
        "tok",
        f"""SELECT DISTINCT {_K}, path, line, replace(regexp_replace(callee, '^self\\.', ''), ').', '(...).') AS callee
 FROM (SELECT {_K}, path, line, unnest(regexp_extract_all(regexp_replace(text, '^ *(?:(?:async +)?def|class) +\\w+', ''),
   '([A-Za-z_][\\w.]*|\\)\\.[\\w.]+)\\s*\\(', 1)) AS callee FROM ln) WHERE callee NOT IN {_list(S.PYTHON_KEYWORDS)}""",
    ),
    (
        "ca",
        """SELECT t.repo, t.commit_sha, t.path, t.line, coalesce(arg_max(f.name, f.start_line), '__module__') AS caller_function, t.callee
 FROM tok t LEFT JOIN fn f ON t.repo = f.repo AND t.path = f.path AND t.line BETWEEN f.start_line AND f.end_line
 GROUP BY t.repo, t.commit_sha, t.path, t.line, t.callee""",
    ),
]

_GRAPH = _LINES + [
    (
        "sy",
        f"""SELECT {_K}, path, id, name, 'class' AS type, 1 AS k, start_line, end_line FROM cl
 UNION ALL SELECT {_K}, path, id, name, 'function', 2, start_line, end_line FROM fn""",
    ),
    (
        "nd0",
        f"""SELECT {_K}, path AS id, path AS label, 'file' AS type, path AS file, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS end_line FROM vc
 UNION ALL SELECT {_K}, id, name, type, path, start_line, end_line FROM sy
 QUALIFY row_number() OVER (PARTITION BY {_K}, id ORDER BY k DESC, start_line DESC) = 1""",
    ),
    ("ix", f"SELECT DISTINCT {_K}, name, id FROM sy"),
    (
        "want",
        f"""SELECT DISTINCT {_K}, CASE WHEN caller_function = '__module__' THEN path ELSE concat(path, '::', caller_function) END AS source,
 string_split(callee, '.')[-1] AS name FROM ca""",
    ),
    ("ce", "SELECT w.repo, w.commit_sha, w.source, ix.id AS target FROM want w JOIN ix ON w.repo = ix.repo AND w.name = ix.name"),
    (
        "ie",
        f"""SELECT DISTINCT im.repo, im.commit_sha, im.path AS source, concat(replace(module, '.', '/'), '.py') AS target FROM im
 JOIN vc ON vc.repo = im.repo AND vc.path = concat(replace(module, '.', '/'), '.py')""",
    ),
    (
        "ev",
        f"""SELECT DISTINCT {_K}, path AS source, id AS target, 'defines' AS type, 1 AS k FROM sy
 UNION ALL SELECT {_K}, source, target, 'calls', 2 FROM ce UNION ALL SELECT {_K}, source, target, 'imports', 3 FROM ie""",
    ),
    ("ed", f"SELECT {_K}, source, target, arg_max(type, k) AS type FROM ev GROUP BY {_K}, source, target"),
    (
        "nd",
        """SELECT n.*, n.type = 'function' AND NOT EXISTS (SELECT 1 FROM ed e WHERE e.repo = n.repo AND e.target = n.id AND e.type = 'calls') AS is_entry_point
 FROM nd0 n""",
    ),
]

_HOSTS = "[a-z.]+\\.example\\.(?:com|net|org)"
_URL = f"'^(?:https?://)?(?:www\\.)?{_HOSTS}/([^/]+)/([^/]+)$'"
REPO_URLS = f"""
SELECT page_id, regexp_matches(u, {_URL}) AS valid,
 CASE WHEN regexp_matches(u, {_URL}) THEN regexp_extract(u, {_URL}, 1) END AS owner,
 CASE WHEN regexp_matches(u, {_URL}) THEN regexp_replace(regexp_extract(u, {_URL}, 2), '\\.git$', '') END AS name
FROM (SELECT page_id, regexp_replace(trim(url), '/+$', '') AS u FROM pages)"""
REPO_PATHS = f"""
SELECT page_id, nullif(regexp_replace(regexp_extract(url, '{_HOSTS}/([^/]+/[^/?#]+)', 1), '\\.git$', ''), '') AS repo_path FROM pages"""

_KEEP = "path LIKE '%.py' AND string_split(path, '/')[-1] <> '__init__.py' AND size <= 100000"
_NO_TERM = " AND ".join(f"NOT contains(path, {_q(t)})" for t in S.EXCLUDED_PATH_TERMS)
_NO_PART = f"NOT list_has_any(string_split(path, '/'), [{', '.join(_q(t) for t in S.EXCLUDED_PATH_TERMS)}])"
DECODED = """SELECT source AS repo, 'c0' AS commit_sha, concat('doc/', doc_id) AS path, CASE WHEN doc_id % 10 = 3 THEN text || chr(65533) ELSE text END AS content
FROM documents WHERE doc_id % 10 <> 4 AND text IS NOT NULL"""
STORED_DOCUMENTS = """SELECT source AS repo, 2 * count(*) AS nodes, count(DISTINCT doc_id) AS ids, CAST(2 * sum(length(text)) AS BIGINT) AS summary_chars, count(*) AS edges
FROM documents WHERE doc_id % 7 NOT IN (1, 2, 3, 4) GROUP BY source
UNION ALL SELECT 'rejects', count(*), NULL, NULL, NULL FROM documents WHERE doc_id % 7 IN (1, 2, 3, 4)"""
LISTING = _with(_VC, f"SELECT {_K}, path, size FROM vc WHERE {_KEEP} AND {_NO_TERM}")
LISTING_SEGMENT = _with(_VC, f"SELECT {_K}, path, size FROM vc WHERE {_KEEP} AND {_NO_PART}")
_LISTED = _VC + [("li", f"SELECT {_K}, path, size FROM vc WHERE {_KEEP} AND {_NO_TERM}")]
WITHIN_LIMIT = _with(_LISTED, f"SELECT * FROM li QUALIFY count(*) OVER (PARTITION BY {_K}) <= {S.MAX_FILES_PER_REPO}")
OVER_LIMIT = _with(
    _LISTED, f"SELECT {_K}, count(*) AS files FROM li GROUP BY {_K} HAVING count(*) > {S.MAX_FILES_PER_REPO}"
)
FILE_SOURCES = _with(
    _LINES,
    f"""SELECT w.repo, w.commit_sha, w.path, vc.content IS NOT NULL AS found, md5(vc.content) AS digest
FROM (SELECT DISTINCT {_K}, concat(replace(module, '.', '/'), '.py') AS path FROM im) w
LEFT JOIN vc ON vc.repo = w.repo AND vc.path = w.path AND vc.content IS NOT NULL""",
)
SNAPSHOT_KEYS = """
SELECT doc_id, concat(regexp_replace(replace(lower(concat('My.Org/', source, '+', lang, '!')), '/', '__'), '[^a-z0-9_\\-]', '_', 'g'),
 '__', regexp_replace(concat('Sha@', doc_id), '[^a-zA-Z0-9_\\-]', '_', 'g'), '.json') AS snapshot_key FROM documents"""
_CATALOG = [
    (
        "cat",
        "SELECT source AS repo, lang AS commit_sha, max(doc_id) * 60 AS cached_at, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source, lang",
    )
]
SNAPSHOT_LISTING = _with(_CATALOG, "SELECT repo, commit_sha, cached_at, round(bytes / 1024, 1) AS size_kb FROM cat")
SNAPSHOT_STATS = _with(
    _CATALOG,
    """SELECT count(*) AS total_entries, round(coalesce(sum(bytes), 0) / 1024, 1) AS total_size_kb,
 min(cached_at) AS oldest_entry, max(cached_at) AS newest_entry FROM cat""",
)
SNAPSHOT_LATEST = """
SELECT concat('Cust/', o_custkey) AS repo, o_orderkey AS commit_sha, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
CONVERSATION_BLOCKS = """
SELECT conv_id, turn, concat(CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN '' ELSE concat(chr(10), chr(10), '---', chr(10), chr(10)) END,
 '[', upper(role), ']', chr(10), text) AS block FROM conversations"""

# --- Symbols and graph -------------------------------------------------------

_VL = [
    (
        "vl",
        f"""SELECT source AS repo, 'c0' AS commit_sha, concat('doc/', doc_id) AS path,
 unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text
 FROM documents WHERE regexp_matches(text, '\\S')""",
    )
]
DOCUMENT_LINES = _with(_VL, "SELECT * FROM vl")
FUNCTIONS = _with(
    _LINES,
    f"""SELECT {_K}, path, id, name, start_line, end_line, array_to_string(parameters, ',') AS parameters, is_method, decorator_names, docstring FROM fn""",
)
CLASSES = _with(
    _LINES,
    f"""SELECT {_K}, path, id, name, start_line, end_line, base_classes, array_to_string(methods, ',') AS method_names, class_variables, docstring FROM cl""",
)
IMPORTS = _with(_LINES, f"SELECT {_K}, path, line, module, names, is_relative FROM im")
CALLS = _with(_LINES, f"SELECT {_K}, path, line, caller_function, callee FROM ca")
PARSED_FILES = _with(
    _LINES,
    """SELECT vc.repo, vc.commit_sha, vc.path, count(*) FILTER (st.kind = 'def') AS defs, count(*) FILTER (st.kind = 'decorator') AS decorators
FROM vc LEFT JOIN st ON vc.repo = st.repo AND vc.path = st.path GROUP BY vc.repo, vc.commit_sha, vc.path""",
)
NODES = _with(_GRAPH, f"SELECT {_K}, id, label, type, file, start_line, end_line, is_entry_point FROM nd")
DEFINES = _with(_GRAPH, f"SELECT DISTINCT {_K}, path AS source, id AS target, 'defines' AS type FROM sy")
NAME_INDEX = _with(_GRAPH, "SELECT * FROM ix")
CALL_EDGES = _with(_GRAPH, "SELECT *, 'calls' AS type FROM ce")
UNRESOLVED = _with(
    _GRAPH,
    f"SELECT {_K}, source, name FROM want w WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.repo = w.repo AND ix.name = w.name)",
)
IMPORT_EDGES = _with(_GRAPH, "SELECT *, 'imports' AS type FROM ie")
EDGES = _with(_GRAPH, "SELECT * FROM ed")
MULTI_EDGES = _with(_GRAPH, f"SELECT DISTINCT {_K}, source, target, type FROM ev")
ENTRY_POINTS = _with(_GRAPH, f"SELECT {_K}, id FROM nd WHERE is_entry_point")

_TRADE = [("gn", views.GRAPH_NODES), ("ge", views.GRAPH_EDGES)]
_ENTRY = [
    (
        "en",
        f"SELECT {_K}, id FROM gn WHERE type = 'function' AND id NOT IN (SELECT target FROM ge WHERE type = 'calls')",
    )
]
TRADE_ENTRIES = _with(_TRADE + _ENTRY, "SELECT * FROM en")
GRAPH_META = _with(
    _TRADE + _ENTRY,
    f"""SELECT {_K}, count(*) AS node_count, (SELECT count(*) FROM ge) AS edge_count, (SELECT count(*) FROM en) AS entry_points
FROM gn GROUP BY {_K}""",
)
SNAPSHOT_ROUND_TRIP = _with(
    _TRADE,
    """SELECT type, count(*) AS rows, count(DISTINCT id) AS ids FROM gn GROUP BY type
UNION ALL SELECT type, count(*), count(DISTINCT source) FROM ge GROUP BY type""",
)


def _pagerank(base: list[tuple[str, str]], nodes: str, edges: str) -> str:
    ctes = base + [
        ("pe", f"SELECT DISTINCT repo, source, target FROM {edges}"),
        ("pd", "SELECT repo, source, count(*) AS d FROM pe GROUP BY repo, source"),
        ("pn", f"SELECT n.repo, n.id, s.n, pd.d FROM {nodes} n JOIN (SELECT repo, count(*) AS n FROM {nodes} GROUP BY repo) s ON n.repo = s.repo LEFT JOIN pd ON n.repo = pd.repo AND n.id = pd.source"),
        ("k0", "SELECT repo, id, 1.0::DOUBLE / n AS r FROM pn"),
    ]
    for i in range(1, ROUNDS + 1):
        p = f"k{i - 1}"
        ctes += [
            (f"f{i}", f"SELECT e.repo, e.target, sum(k.r / pd.d) AS r FROM pe e JOIN {p} k ON e.repo = k.repo AND e.source = k.id JOIN pd ON e.repo = pd.repo AND e.source = pd.source GROUP BY e.repo, e.target"),
            (f"l{i}", f"SELECT pn.repo, sum(k.r) AS r FROM pn JOIN {p} k ON pn.repo = k.repo AND pn.id = k.id WHERE pn.d IS NULL GROUP BY pn.repo"),
            (f"k{i}", f"SELECT pn.repo, pn.id, 0.85::DOUBLE * (coalesce(f.r, 0) + coalesce(l.r, 0) / pn.n) + 0.15::DOUBLE / pn.n AS r FROM pn LEFT JOIN f{i} f ON pn.repo = f.repo AND pn.id = f.target LEFT JOIN l{i} l ON pn.repo = l.repo"),
        ]
    return _with(ctes, f"SELECT repo, 'c0' AS commit_sha, id, round(r, 9) AS centrality FROM k{ROUNDS}")


PAGERANK_TRADE = _pagerank(_TRADE, "gn", "ge")
PAGERANK_CODE = _pagerank(_GRAPH, "nd", "ed")

# --- Rules -------------------------------------------------------------------


def _literal(pattern: str) -> str:
    return _q(pattern)


def _secret_case(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({text}, {_literal('(?i)' + p)}) THEN {_q(n)}" for n, p in S.SECRET_RULES
    ) + " END"


_COMMENT = "regexp_matches(text, '^\\s*#')"
_TEST = "(starts_with(path, 'test_') OR contains(path, '/test_') OR contains(path, '/tests/'))"
_NOT_EXCLUDED = " AND ".join(f"NOT contains(text, {_q(t)})" for t in S.SECRET_EXCLUDED_TERMS)


def _message(name: str, *values: str) -> str:
    parts = S.MESSAGES[name].split("%s")
    out = []
    for i, p in enumerate(parts):
        if p:
            out.append(_q(p))
        if i < len(values):
            out.append(values[i])
    return "concat(" + ", ".join(out) + ")"


def _secrets(source: str) -> str:
    return f"""SELECT {_K}, path AS file, line, 'high' AS severity, 'security' AS type, {_message('secret', 'kind')} AS message
FROM (SELECT *, {_secret_case('text')} AS kind FROM {source} WHERE NOT {_COMMENT} AND {_NOT_EXCLUDED}) WHERE kind IS NOT NULL"""


_INJECTIONS = f"""SELECT {_K}, path AS file, line, 'high' AS severity, 'security' AS type, {_message('sql')} AS message
FROM raw WHERE NOT {_COMMENT} AND regexp_matches(text, {_literal(S.SQL_INJECTION_PATTERN)})"""
_EVALS = f"""SELECT {_K}, path AS file, line, 'high' AS severity, 'security' AS type, {_message('eval')} AS message
FROM raw WHERE NOT {_COMMENT} AND regexp_matches(text, {_literal(S.EVAL_PATTERN)})"""
_DEBUGS = f"""SELECT {_K}, path AS file, line, 'medium' AS severity, 'quality' AS type, {_message('debug')} AS message
FROM raw WHERE NOT {_COMMENT} AND NOT {_TEST} AND regexp_matches(text, {_literal('|'.join(S.DEBUG_PATTERNS))})"""
_TODO = _literal("(?i)" + S.TODO_PATTERN)
_TODOS = f"""SELECT {_K}, path AS file, line, 'low' AS severity, 'quality' AS type,
{_message('todo', f"substr(regexp_replace(regexp_extract(text, {_TODO}, 2), '^\\s+|\\s+$', '', 'g'), 1, {S.TODO_CHARS})")} AS message
FROM raw WHERE regexp_matches(text, {_TODO})"""

DOCUMENT_SECRETS = _with(_VL, _secrets("vl"))
LEAKS_RANKED = _with(
    _VL,
    f"""SELECT {_K}, file, count(*) AS issue_count, 'high' AS severity
FROM (SELECT DISTINCT {_K}, file, line, message FROM ({_secrets('vl')})) GROUP BY {_K}, file""",
)
TEST_FILES = _with(_VC, f"SELECT {_K}, path, {_TEST} AS is_test FROM vc")
COMMENTS = _with(
    _RAW, f"SELECT {_K}, path, count(*) FILTER ({_COMMENT}) AS comments, count(*) AS lines FROM raw GROUP BY {_K}, path"
)
SECRETS = _with(_RAW, _secrets("raw"))
INJECTIONS = _with(_RAW, _INJECTIONS)
EVALS = _with(_RAW, _EVALS)
DEBUGS = _with(_RAW, _DEBUGS)
TODOS = _with(_RAW, _TODOS)

# --- Structure ---------------------------------------------------------------

_LONG = f"""SELECT {_K}, file, start_line AS line, 'medium' AS severity, 'quality' AS type,
{_message('long', 'label', '(end_line - start_line)')} AS message FROM nd WHERE type = 'function' AND end_line - start_line > 50"""


def _many(limit: int) -> str:
    return f"""SELECT {_K}, path AS file, start_line AS line, 'medium' AS severity, 'quality' AS type,
{_message('params', 'name', 'len(parameters)')} AS message FROM fn WHERE len(parameters) > {limit}"""


_DOCS = f"""SELECT {_K}, path AS file, 1 AS line, 'low' AS severity, 'quality' AS type, {_message('docs', 'missing')} AS message
FROM (SELECT {_K}, path, count(*) AS n, count(*) FILTER (docstring IS NULL) AS missing FROM fn
 WHERE NOT starts_with(name, '_') AND NOT is_method GROUP BY {_K}, path) WHERE missing / n > 0.3"""
_GOD = f"""SELECT {_K}, path AS file, start_line AS line, 'medium' AS severity, 'quality' AS type,
{_message('god', 'name', 'len(methods)')} AS message FROM cl WHERE len(methods) > 15"""
_CYCLE = f"""SELECT a.repo, a.commit_sha, a.source AS file, 1 AS line, 'medium' AS severity, 'quality' AS type,
{_message('cycle', 'a.source', 'a.target')} AS message FROM ed a JOIN ed b ON a.repo = b.repo AND a.source = b.target AND a.target = b.source
WHERE a.type = 'imports' AND b.type = 'imports' AND a.source < a.target"""
_DEAD = f"""SELECT {_K}, file, start_line AS line, 'low' AS severity, 'dead_code' AS type, {_message('dead', 'label')} AS message
FROM nd WHERE is_entry_point AND NOT starts_with(label, '_') AND NOT starts_with(label, 'test_') AND label NOT IN {_list(S.USED_BY_CONVENTION)}"""
LONG = _with(_GRAPH, _LONG)
MANY_PARAMETERS = _with(_GRAPH, _many(5))
MISSING_DOCS = _with(_GRAPH, _DOCS)
GOD_OBJECTS = _with(_GRAPH, _GOD)
CYCLES = _with(_GRAPH, _CYCLE)
DEAD = _with(_GRAPH, _DEAD)


def _pattern(name: str, text: str, source: str, where: str) -> str:
    return f"""SELECT {_K}, {_q(name)} AS name, path AS file, name AS class, {_q(S.PATTERN_TEXT[text])} AS description FROM {source} WHERE {where}"""


def _made(name: str) -> str:
    return f"(contains(lower({name}), 'factory') OR starts_with({name}, 'create_'))"


def _names(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


_PATTERNS = {
    "SINGLETONS": _pattern("Singleton", "Singleton", "cl", f"list_has_any(methods, {_names(S.SINGLETON_METHODS)}) OR list_contains(string_split(class_variables, ','), '_instance')"),
    "FACTORY_CLASSES": _pattern("Factory", "Factory", "cl", f"contains(lower(name), 'factory') OR len(list_filter(methods, lambda m: {_made('m')})) > 0"),
    "REPOSITORIES": _pattern("Repository", "Repository", "cl", f"len(list_intersect(methods, {_names(S.REPOSITORY_METHODS)})) >= 3"),
    "CONTEXT_MANAGERS": _pattern("Context Manager", "Context Manager", "cl", f"list_has_all(methods, {_names(S.CONTEXT_METHODS)})"),
    "FACTORY_FUNCTIONS": _pattern("Factory", "Factory function", "fn", _made("name")),
    "DECORATORS": _pattern("Decorator", "Decorator", "fn", f"list_has_any(parameters, {_names(S.DECORATOR_PARAMETERS)})"),
}
SINGLETONS, FACTORY_CLASSES, REPOSITORIES, CONTEXT_MANAGERS, FACTORY_FUNCTIONS, DECORATORS = (
    _with(_GRAPH, _PATTERNS[k])
    for k in ("SINGLETONS", "FACTORY_CLASSES", "REPOSITORIES", "CONTEXT_MANAGERS", "FACTORY_FUNCTIONS", "DECORATORS")
)
_ALL_PATTERNS = " UNION ALL ".join(f"SELECT *, {i} AS rule FROM ({t})" for i, t in enumerate(_PATTERNS.values()))
_FOUND = _GRAPH + [("raw", _RAW[1][1])] + [
    (
        "pt",
        f"SELECT {_K}, name, file, class, arg_min(description, rule) AS description FROM ({_ALL_PATTERNS}) GROUP BY {_K}, name, file, class",
    ),
    (
        "is0",
        " UNION ALL ".join(
            f"SELECT {_K}, file, line, severity, type, message, {fn} AS function, {i} AS rule FROM ({t})"
            for i, (t, fn) in enumerate([
                (_secrets("raw"), "NULL"), (_INJECTIONS, "NULL"), (_EVALS, "NULL"), (_DEBUGS, "NULL"), (_TODOS, "NULL"),
                (_LONG.replace("AS message FROM", "AS message, label FROM"), "label"),
                (_many(6).replace("AS message FROM", "AS message, name FROM"), "name"),
                (_DOCS, "NULL"), (_GOD, "NULL"), (_CYCLE, "NULL"),
                (_DEAD.replace("AS message\nFROM", "AS message, label\nFROM"), "label"),
            ])
        ),
    ),
    (
        "iss",
        f"""SELECT {_K}, sha256(concat_ws('|', file, line, message)) AS id, file, line, arg_min(severity, rule) AS severity, arg_min(type, rule) AS type, message,
 (arg_min({{'f': function}}, rule)).f AS function FROM is0 GROUP BY {_K}, file, line, message""",
    ),
    (
        "fi",
        f"""SELECT {_K}, file, count(*) AS issue_count, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)
 WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity FROM iss GROUP BY {_K}, file""",
    ),
    (
        "me",
        f"""SELECT {_K}, count(*) FILTER (type = 'file') AS total_files, count(*) FILTER (type = 'function') AS total_functions,
 count(*) FILTER (type = 'class') AS total_classes, CAST(coalesce(sum(end_line - start_line) FILTER (type = 'function'), 0) AS BIGINT) AS total_length,
 coalesce(max(end_line - start_line) FILTER (type = 'function'), 0) AS max_function_length,
 count(*) FILTER (type = 'function' AND (starts_with(label, 'test_') OR contains(file, 'test'))) AS test_functions FROM nd GROUP BY {_K}""",
    ),
    (
        "mc",
        f"""SELECT {_K}, file AS most_complex_file FROM (SELECT {_K}, file, count(*) AS c FROM nd WHERE type <> 'file' GROUP BY {_K}, file)
 QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY c DESC, file) = 1""",
    ),
]
UNIQUE_PATTERNS = _with(_FOUND, "SELECT * FROM pt")
UNIQUE_ISSUES = _with(_FOUND, "SELECT * FROM iss")
FILE_ISSUES = _with(_FOUND, "SELECT * FROM fi")
BADGES = _with(
    _FOUND,
    """SELECT n.repo, n.commit_sha, n.id, coalesce(fi.issue_count, 0) AS issue_count, fi.severity AS issue_severity
FROM nd n LEFT JOIN fi ON n.repo = fi.repo AND n.file = fi.file""",
)
_GRADE = "CASE " + " ".join(f"WHEN score >= {b} THEN '{g}'" for b, g in S.GRADES) + f" ELSE '{S.LAST_GRADE}' END"
HEALTH = _with(
    _FOUND,
    f"""SELECT {_K}, score, {_GRADE} AS grade, total_files, total_functions, total_classes, avg_function_length, max_function_length,
 most_complex_file, dead_code_count, circular AS circular_import_count, test_coverage_estimate FROM (
 SELECT me.repo, me.commit_sha, total_files, total_functions, total_classes, max_function_length, most_complex_file,
  coalesce(dead, 0) AS dead_code_count, coalesce(circular, 0) AS circular,
  round(total_length::DOUBLE / total_functions, 1) AS avg_function_length, round(test_functions::DOUBLE / total_functions, 2) AS test_coverage_estimate,
  greatest(0, least(100, 100 - 8 * coalesce(h, 0) - 3 * coalesce(m, 0) - coalesce(l, 0) + 2 * coalesce(p, 0) - 10 * coalesce(circular, 0)
   - CASE WHEN coalesce(dead, 0) / total_functions > 0.2 THEN 10 ELSE 0 END - CASE WHEN total_length / total_functions > 40 THEN 5 ELSE 0 END)) AS score
 FROM me LEFT JOIN mc ON me.repo = mc.repo
 LEFT JOIN (SELECT repo, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l,
  count(*) FILTER (type = 'dead_code') AS dead, count(*) FILTER (contains(message, 'Circular import')) AS circular FROM iss GROUP BY repo) i ON me.repo = i.repo
 LEFT JOIN (SELECT repo, count(*) AS p FROM pt GROUP BY repo) q ON me.repo = q.repo)""",
)
GRADES = f"SELECT doc_id, score, {_GRADE} AS grade FROM (SELECT doc_id, n_chars % 101 AS score FROM documents)"
METRICS = _with(_FOUND, "SELECT *, round(test_functions::DOUBLE / total_functions, 2) AS coverage FROM me")
COMPLEX = _with(_FOUND, "SELECT * FROM mc")
SEVERITY_TOTALS = _with(
    _FOUND,
    f"""SELECT {_K}, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
 count(*) FILTER (severity = 'low') AS low FROM iss GROUP BY {_K}""",
)
RANKED_FILES = FILE_ISSUES
FILTERED_ISSUES = _with(
    _FOUND,
    """SELECT i.repo, i.commit_sha, i.file, fi.severity AS file_severity, i.line, i.message FROM iss i
JOIN fi ON i.repo = fi.repo AND i.file = fi.file WHERE i.severity = 'medium'""",
)
ISSUE_NODES = _with(
    _FOUND,
    """SELECT i.repo, i.commit_sha, i.file, i.line, i.message, i.function,
 coalesce((SELECT min(n.id) FROM nd n WHERE n.repo = i.repo AND n.file = i.file AND n.label = i.function),
  (SELECT min(n.id) FROM nd n WHERE n.repo = i.repo AND n.id = i.file)) AS node_id FROM iss i""",
)

# --- Impact ------------------------------------------------------------------

_SEVERITY = "CASE WHEN depth = 0 THEN 'source' WHEN depth = 1 THEN 'critical' WHEN depth = 2 THEN 'high' WHEN depth <= 4 THEN 'medium' ELSE 'low' END"
REVERSE = _with(_TRADE, f"SELECT DISTINCT {_K}, target AS id, source AS dependent FROM ge")
_BLAST = _TRADE + [
    (
        "r_b",
        """SELECT concat('N', s_nationkey) AS seed, concat('S', s_suppkey) AS id, 0 AS depth FROM supplier
 UNION SELECT r_b.seed, ge.source, r_b.depth + 1 FROM r_b JOIN ge ON ge.target = r_b.id WHERE r_b.depth < 6""",
    ),
    (
        "af",
        f"SELECT *, {_SEVERITY} AS severity FROM (SELECT 'supply' AS repo, 'c0' AS commit_sha, seed, id, min(depth) AS depth FROM r_b GROUP BY seed, id)",
    ),
]
BLAST = _with(_BLAST, f"SELECT {_K}, seed, id, depth, severity FROM af", True)
_BLAST_CODE = _GRAPH + [
    (
        "r_b",
        """SELECT repo, id, 0 AS depth FROM nd WHERE type = 'class'
 UNION SELECT ed.repo, ed.source, r_b.depth + 1 FROM r_b JOIN ed ON ed.repo = r_b.repo AND ed.target = r_b.id WHERE r_b.depth < 6""",
    ),
    (
        "af",
        f"SELECT *, {_SEVERITY} AS severity FROM (SELECT repo, 'c0' AS commit_sha, 'classes' AS seed, id, min(depth) AS depth FROM r_b GROUP BY repo, id)",
    ),
]
BLAST_CODE = _with(_BLAST_CODE, f"SELECT {_K}, seed, id, depth, severity FROM af", True)
PATHS = _with(
    _BLAST
    + [
        (
            "r_p",
            """SELECT concat('N', s_nationkey) AS seed, concat('S', s_suppkey) AS id, [concat('S', s_suppkey)] AS path, 0 AS depth FROM supplier
 UNION ALL SELECT r_p.seed, ge.source, list_append(r_p.path, ge.source), r_p.depth + 1 FROM r_p JOIN ge ON ge.target = r_p.id WHERE r_p.depth < 6""",
        ),
        ("fp", "SELECT seed, id, depth, path FROM r_p QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY depth, path) = 1"),
        (
            "al",
            """SELECT seed, id, -1 AS depth, path FROM fp WHERE depth = 0
 UNION ALL SELECT fp.seed, ge.source, fp.depth, list_append(fp.path, ge.source) FROM fp JOIN ge ON ge.target = fp.id WHERE fp.depth < 6""",
        ),
    ],
    """SELECT 'supply' AS repo, 'c0' AS commit_sha, seed, id, rank, array_to_string(path, '>') AS path FROM (
 SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY depth, path) AS rank FROM al) WHERE rank <= 3""",
    True,
)
IMPACT_TOTALS = _with(_BLAST, f"SELECT {_K}, seed, count(*) FILTER (depth > 0) AS total FROM af GROUP BY {_K}, seed", True)
IMPACT_DEPTHS = _with(_BLAST, f"SELECT {_K}, seed, depth, count(*) AS nodes FROM af GROUP BY {_K}, seed, depth", True)
IMPACT_SEVERITIES = _with(
    _BLAST,
    f"""SELECT s.repo, s.commit_sha, s.seed, v.severity, (SELECT count(*) FROM af WHERE af.seed = s.seed AND af.severity = v.severity) AS nodes
FROM (SELECT DISTINCT {_K}, seed FROM af) s, (SELECT unnest({_names(S.BLAST_SEVERITIES)}) AS severity) v""",
    True,
)
_RISK = _BLAST + _ENTRY + [
    (
        "r_f",
        """SELECT id AS entry, id FROM en UNION SELECT r_f.entry, ge.target FROM r_f JOIN ge ON ge.source = r_f.id AND ge.type IN ('calls', 'imports')""",
    ),
    (
        "hit",
        "SELECT af.seed, r_f.entry, r_f.id FROM r_f JOIN af ON af.id = r_f.id WHERE r_f.id <> r_f.entry",
    ),
    (
        "ri",
        """SELECT hit.seed, hit.entry, CASE WHEN bool_or(coalesce(s_acctbal < 0, false)) THEN 'high' ELSE 'medium' END AS risk
 FROM hit LEFT JOIN supplier ON concat('S', s_suppkey) = hit.id GROUP BY hit.seed, hit.entry""",
    ),
]
AT_RISK = _with(_RISK, "SELECT 'supply' AS repo, 'c0' AS commit_sha, seed, entry AS entry_point, risk FROM ri", True)
AFFECTED_BY_ENTRY = _with(_RISK, "SELECT 'supply' AS repo, 'c0' AS commit_sha, seed, entry AS entry_point, id FROM hit", True)


def _first5(key: str, other: str, kind: str) -> str:
    return f"""SELECT id, string_agg(other, ',' ORDER BY other) AS v FROM (SELECT {key} AS id, {other} AS other,
 row_number() OVER (PARTITION BY {key} ORDER BY {other}) AS k FROM (SELECT DISTINCT source, target FROM ge WHERE type = '{kind}')) WHERE k <= 5 GROUP BY id"""


_AROUND = [
    ("n1", _first5("target", "source", "calls")),
    ("n2", _first5("source", "target", "calls")),
    ("n3", _first5("target", "source", "imports")),
    (
        "nb",
        """SELECT gn.repo, gn.commit_sha, gn.id, coalesce(n1.v, '') AS callers, coalesce(n2.v, '') AS callees, coalesce(n3.v, '') AS importers
 FROM gn LEFT JOIN n1 ON n1.id = gn.id LEFT JOIN n2 ON n2.id = gn.id LEFT JOIN n3 ON n3.id = gn.file""",
    ),
]
NEIGHBOURHOOD = _with(_TRADE + _AROUND, "SELECT * FROM nb")
_PAYLOAD = """SELECT 'supply' AS repo, 'c0' AS commit_sha, seed, 'affected_count' AS item, '' AS id, CAST(count(*) FILTER (depth > 0) AS VARCHAR) AS value FROM af GROUP BY seed
UNION ALL SELECT 'supply', 'c0', seed, 'critical_node', id, 'critical' FROM af WHERE severity = 'critical'
UNION ALL SELECT 'supply', 'c0', seed, 'broken_pipeline', entry, risk FROM ri"""
PAYLOAD = _with(_RISK, _PAYLOAD, True)


def _show(name: str) -> str:
    return f"concat('[', replace({name}, ',', ', '), ']')"


#: Every supplier is a change of its own.
PROMPT_PARTS_EACH = _with(
    _RISK
    + _AROUND
    + [
        ("pr", "SELECT concat('N', s_nationkey) AS seed, concat('S', s_suppkey) AS id FROM supplier"),
        (
            "pf",
            """SELECT pr.seed, gn.*, nb.callers, nb.callees, nb.importers, (SELECT count(*) FROM af WHERE af.seed = pr.seed AND depth > 0) AS total
 FROM pr JOIN gn ON gn.id = pr.id JOIN nb ON nb.id = pr.id""",
        ),
    ],
    f"""SELECT 'supply' AS repo, 'c0' AS commit_sha, seed, part, item, text FROM (
SELECT seed, 1 AS part, '' AS item, concat_ws(chr(10), concat('Repository: ', repo), concat('Changed node: ', id), concat('Type: ', type), 'Summary: ', concat('File: ', file),
 concat('Proposed change: Replace ', id), concat('Affected nodes: ', total)) AS text FROM pf
UNION ALL SELECT seed, 2, id, concat('Direct dependent: ', id) FROM af WHERE severity = 'critical'
UNION ALL SELECT seed, 3, entry, concat('Pipeline at risk: ', entry, ' (', risk, ')') FROM ri
UNION ALL SELECT seed, 4, '', concat_ws(chr(10), concat('Called by: ', {_show('callers')}), concat('Calls: ', {_show('callees')}), concat('Imported by: ', {_show('importers')})) FROM pf
UNION ALL SELECT seed, 5, '', 'First the dependents that fail once this change lands, then the tests that would show it. The last line reads RISK_LEVEL: [{"|".join(S.RISK_LEVELS)}]' FROM pf)""",
    True,
).replace("concat('N', s_nationkey) AS seed", "concat('S', s_suppkey) AS seed")
RISK_LEVELS = f"""
SELECT doc_id, coalesce(nullif(upper(regexp_extract(concat(text, chr(10), ['Risk_level: safe', 'RISK_LEVEL:RISKY', 'risk_level:  dangerous.', 'no verdict'][doc_id % 4 + 1]),
 '(?i)RISK_LEVEL:\\s*({"|".join(S.RISK_LEVELS)})', 1)), ''), '{S.DEFAULT_RISK}') AS risk_level FROM documents"""
CASCADE = _with(
    _BLAST,
    """SELECT a.repo, a.commit_sha, a.seed, a.severity AS level, a.rank, a.id, gn.label, 0 AS more FROM (
 SELECT *, row_number() OVER (PARTITION BY seed, severity ORDER BY id) AS rank FROM af) a JOIN gn ON gn.id = a.id
 WHERE (severity = 'critical' AND rank <= 4) OR (severity = 'high' AND rank <= 3)
UNION ALL SELECT 'supply', 'c0', seed, level, 0, NULL, NULL, more FROM (
 SELECT seed, unnest(['critical', 'high', 'transitive']) AS level, unnest([greatest(count(*) FILTER (severity = 'critical') - 4, 0),
  greatest(count(*) FILTER (severity = 'high') - 3, 0), count(*) FILTER (depth >= 3)]) AS more FROM af GROUP BY seed)""",
    True,
)
EDGE_IMPACT = _with(
    _BLAST_CODE,
    """SELECT e.repo, e.commit_sha, e.source, e.target, e.type, CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL
 THEN CASE WHEN s.severity IN ('critical', 'high') THEN s.severity ELSE 'medium' END
 WHEN s.id IS NOT NULL OR t.id IS NOT NULL THEN 'dim' ELSE 'hidden' END AS impact
FROM ed e LEFT JOIN af s ON s.repo = e.repo AND s.id = e.source LEFT JOIN af t ON t.repo = e.repo AND t.id = e.target""",
    True,
)

# --- Summaries ---------------------------------------------------------------

_ORDERED = _GRAPH + [
    (
        "so",
        f"""SELECT {_K}, file, CASE WHEN type = 'class' THEN 0 ELSE 1 END AS kind_order, start_line, id, label, type FROM nd WHERE type <> 'file'""",
    ),
    ("sr", f"SELECT *, row_number() OVER (PARTITION BY {_K}, file ORDER BY kind_order, start_line, id) AS rank FROM so"),
]
SYMBOLS_BY_FILE = _with(_ORDERED, "SELECT * FROM so")
FIRST_ITEMS = _with(_ORDERED, f"SELECT {_K}, file, rank, id FROM sr WHERE rank <= 10")
PROMPTS = _with(
    _ORDERED,
    f"""SELECT {_K}, file, CAST(count(*) AS INTEGER) AS items, md5(concat('File: ', file, chr(10), chr(10), 'Symbols of the file, in order:', chr(10), '[',
 string_agg(concat('{{"name":"', label, '","type":"', type, '","start_line":', start_line, '}}'), ',' ORDER BY rank), ']', chr(10), chr(10),
 'Give back a single JSON object. Keys: the names as written. Values: what each one does, in 20 words or fewer.')) AS digest
FROM sr WHERE rank <= {S.ITEMS_PER_PROMPT} GROUP BY {_K}, file""",
)
#: Raw answers made from whole documents.  ``$BODY`` is the text reduced to
#: words, which the engines spell differently.
ANSWERS = """SELECT doc_id, lang, CASE
 WHEN doc_id % 7 = 0 THEN 'not json at all'
 WHEN doc_id % 7 = 1 THEN concat('["', doc_id, '"]')
 WHEN doc_id % 7 = 2 THEN concat('```json', chr(10), '{"run_', doc_id, '": "', body, '", "n": 3, "o": {"a": "b"}}', chr(10), '```')
 WHEN doc_id % 7 = 3 THEN concat('  {"a": "', body, '", "b": "short one"}  ')
 WHEN doc_id % 7 = 4 THEN concat('```', chr(10), '{"a": true, "b": null, "c": ["x"]}', chr(10), '```')
 WHEN doc_id % 7 = 5 THEN ''
 ELSE concat('{"a": "', body, '"') END AS response
 FROM (SELECT doc_id, lang, $BODY AS body FROM documents) d"""
_BODY = "trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'))"
_ANSWER_ROWS = """SELECT doc_id, unnest([concat('run_', doc_id)]) AS name, body FROM a WHERE doc_id % 7 = 2
UNION ALL SELECT doc_id, 'a', body FROM a WHERE doc_id % 7 = 3 UNION ALL SELECT doc_id, 'b', 'short one' FROM a WHERE doc_id % 7 = 3"""
RESPONSES = _with(
    [("a", "SELECT doc_id, trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) AS body FROM documents")],
    f"""SELECT doc_id, name, CASE WHEN len(string_split(body, ' ')) > {S.SUMMARY_WORDS}
 THEN concat(array_to_string(list_slice(string_split(body, ' '), 1, {S.SUMMARY_WORDS}), ' '), ' ...') ELSE body END AS summary FROM ({_ANSWER_ROWS})""",
)
FALLBACK = _with(
    [("a", ANSWERS.replace("$BODY", _BODY))],
    "SELECT doc_id, md5(CASE WHEN lang <> 'en' THEN response ELSE concat('second ', lang) END) AS digest FROM a",
)
MERGED_ALL = _with(_GRAPH, f"SELECT {_K}, id, CASE WHEN type = 'function' THEN concat('Runs ', label) ELSE '' END AS summary FROM nd")

# --- Conversations -----------------------------------------------------------

_OUTLINE = _GRAPH + [
    ("of", f"SELECT {_K}, id FROM nd WHERE type = 'file' QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY id) <= {S.OUTLINE_FILES}"),
    (
        "ol",
        f"""SELECT {_K}, id AS file, 0 AS start_line, id, concat('  ', id) AS line FROM of
 UNION ALL SELECT nd.repo, nd.commit_sha, nd.file, nd.start_line, nd.id, concat('    ', CASE WHEN nd.type = 'function' THEN 'def ' ELSE 'class ' END, nd.label)
 FROM nd JOIN of ON of.repo = nd.repo AND of.id = nd.file WHERE nd.type <> 'file'""",
    ),
]
OUTLINE = _with(_OUTLINE, "SELECT * FROM ol")
OUTLINE_TEXT = _with(
    _OUTLINE, f"SELECT {_K}, file, md5(string_agg(line, chr(10) ORDER BY start_line, id)) AS digest FROM ol GROUP BY {_K}, file"
)
ENTRY_CONTEXT = _with(
    _GRAPH,
    f"""SELECT * FROM (SELECT {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY id) AS rank, id, concat('  ', id, ': ') AS line
FROM nd WHERE is_entry_point) WHERE rank <= {S.OUTLINE_ENTRIES}""",
)
CALL_CONTEXT = _with(
    _GRAPH,
    f"""SELECT * FROM (SELECT {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY source, target) AS rank, concat('  ', source, ' → ', target) AS line
FROM ed WHERE type = 'calls') WHERE rank <= {S.OUTLINE_CALLS}""",
)
LAST_MESSAGES = f"""
SELECT * FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, role, text FROM conversations)
WHERE rank <= {S.HISTORY_MESSAGES}"""
SUGGESTIONS = _with(
    _GRAPH
    + [
        ("rf", f"SELECT {_K}, list(string_split(id, '/')[-1] ORDER BY id) AS f FROM nd WHERE type = 'file' GROUP BY {_K}"),
        ("re", f"SELECT {_K}, arg_min(label, id) AS entry FROM nd WHERE is_entry_point GROUP BY {_K}"),
        (
            "qs",
            f"""SELECT rf.repo, rf.commit_sha, list_filter(['Explain the overall architecture of this project', 'What are the entry points and how do they connect?',
 CASE WHEN entry IS NOT NULL THEN concat('What does `', entry, '` do and what calls it?') END,
 CASE WHEN len(f) > 3 THEN concat('How does `', f[1], '` relate to `', f[2], '`?') END], lambda q: q IS NOT NULL) AS q
 FROM rf LEFT JOIN re ON rf.repo = re.repo""",
        ),
    ],
    f"SELECT {_K}, unnest(generate_series(1, len(q))) AS rank, unnest(q) AS question FROM qs",
)
_DOC_REPO = "CASE WHEN CAST(floor(doc_id / 50) AS BIGINT) % 3 = 0 THEN 'acme/mono' ELSE concat('acme/repo_', CAST(floor(doc_id / 50) AS BIGINT)) END"
_DOC_PATH = views.path_of("doc_id")
#: Answers that quote whole documents and cite code; both engines read this.
CHAT_ANSWERS = f"""SELECT doc_id, {_DOC_REPO} AS repo, 'c0' AS commit_sha, concat(replace(text, chr(96), ' '), ' see `', {_DOC_PATH}, '::helper_', doc_id,
 '` and `', {_DOC_PATH}, '` or `run_', doc_id, '`, not `x::y`', chr(10), 'References:', chr(10), '  NODE: ', {_DOC_PATH}, '::Store_', doc_id, chr(10),
 'NODE: missing::node', chr(10), 'Node: ', {_DOC_PATH}, chr(10), 'NODE:', {_DOC_PATH}, ' `', {_DOC_PATH}, '::run_', doc_id, '`') AS answer FROM documents"""
_CHAT = _GRAPH + [("ch", CHAT_ANSWERS)]
ANSWER_REFERENCES = _with(
    _CHAT
    + [
        (
            "cx",
            f"""SELECT {_K}, doc_id, trim(substr(trim(l), 6)) AS id FROM (SELECT {_K}, doc_id, unnest(string_split(answer, chr(10))) AS l FROM ch) WHERE starts_with(trim(l), 'NODE:')""",
        )
    ],
    "SELECT cx.* FROM cx JOIN nd ON nd.repo = cx.repo AND nd.id = cx.id",
)
INLINE_REFERENCES = _with(
    _CHAT
    + [
        (
            "cx",
            f"""SELECT {_K}, doc_id, unnest(t) AS id, unnest(generate_series(0, len(t) - 1)) AS ordinal FROM (
 SELECT {_K}, doc_id, regexp_extract_all(regexp_replace(answer, '(?s)(?:\\n|^)References:.*', ''), '`([^`]+)`', 1) AS t FROM ch)""",
        )
    ],
    "SELECT cx.repo, cx.commit_sha, cx.doc_id, cx.ordinal, cx.id FROM cx JOIN nd ON nd.repo = cx.repo AND nd.id = cx.id WHERE contains(cx.id, '::')",
)
IMPACT_REFERENCES = _with(
    _CHAT
    + [
        ("cx", f"SELECT {_K}, doc_id, unnest(regexp_extract_all(answer, '`([^`]+)`', 1)) AS token FROM ch"),
        ("nm", "SELECT repo, token, (min({'o': o, 'id': id})).id AS id FROM (SELECT repo, id AS token, 0 AS o, id FROM nd UNION ALL SELECT repo, label, 1, id FROM nd) GROUP BY repo, token"),
    ],
    "SELECT cx.repo, cx.commit_sha, cx.doc_id, cx.token, nm.id FROM cx JOIN nm ON nm.repo = cx.repo AND nm.token = cx.token",
)

# --- Exploration -------------------------------------------------------------

SEARCH = _with(
    _TRADE,
    f"SELECT {_K}, id, label, type, file FROM gn WHERE contains(lower(label), 'r1/n1') OR contains(lower(file), 'r1/n1') ORDER BY id LIMIT 10",
)
CALL_NEIGHBOURS = _with(
    _TRADE
    + [
        (
            "cn",
            """SELECT target AS id, 'caller' AS direction, source AS other FROM ge WHERE type = 'calls'
 UNION ALL SELECT source, 'callee', target FROM ge WHERE type = 'calls'""",
        )
    ],
    f"""SELECT 'supply' AS repo, 'c0' AS commit_sha, c.id, c.direction, c.rank, c.other, gn.label, greatest(c.n - 8, 0) AS hidden FROM (
 SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY other) AS rank, count(*) OVER (PARTITION BY id, direction) AS n FROM cn) c
JOIN gn ON gn.id = c.other WHERE c.rank <= 8""",
)
DEGREES = _with(
    _TRADE,
    f"""SELECT {_K}, id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM gn
LEFT JOIN (SELECT target, count(*) AS n FROM ge GROUP BY target) i ON i.target = gn.id
LEFT JOIN (SELECT source, count(*) AS n FROM ge GROUP BY source) o ON o.source = gn.id""",
)
_DIRS = _GRAPH + [
    (
        "dg",
        f"""SELECT {_K}, CASE WHEN contains(file, '/') THEN string_split(file, '/')[1] ELSE '__root__' END AS dir, count(*) AS nodes FROM nd
 GROUP BY {_K}, dir HAVING count(*) >= 2""",
    )
]
DIRECTORIES = _with(_DIRS, "SELECT * FROM dg")
FIRST_DIRECTORIES = _with(
    _DIRS,
    f"""SELECT {_K}, rank, dir, nodes, greatest(n - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY dir) AS rank,
 count(*) OVER (PARTITION BY {_K}) AS n FROM dg) WHERE rank <= 3""",
)
_TREE = _GRAPH + [
    ("px", f"SELECT {_K}, file, string_split(file, '/') AS parts, count(*) FILTER (type = 'function') AS f, count(*) FILTER (type = 'class') AS c FROM nd GROUP BY {_K}, file"),
    ("py", f"SELECT *, unnest(generate_series(1, len(parts))) AS i FROM px"),
    (
        "tr",
        f"""SELECT {_K}, array_to_string(parts[1:i], '/') AS path, array_to_string(parts[1:i-1], '/') AS parent, parts[i] AS name, i AS depth,
 i = len(parts) AS is_file, count(*) AS files, CAST(sum(f) AS BIGINT) AS functions, CAST(sum(c) AS BIGINT) AS classes FROM py GROUP BY ALL""",
    ),
]
TREE = _with(_TREE, "SELECT * FROM tr")
TREE_SEARCH = _with(
    _TREE,
    f"SELECT DISTINCT {_K}, array_to_string(parts[1:i], '/') AS path, i = len(parts) AS is_file FROM py WHERE contains(lower(file), 'sub1/m')",
)
FILE_SYMBOLS = _with(_GRAPH, f"SELECT {_K}, file, start_line, id, label, type FROM nd WHERE type <> 'file'")
TYPE_TOTALS = _with(_TRADE, f"SELECT {_K}, type, count(*) AS nodes FROM gn GROUP BY {_K}, type")
FILE_TOTALS = _with(
    _GRAPH,
    f"""SELECT vc.repo, vc.commit_sha, vc.path, len(string_split(content, chr(10))) AS lines, count(*) FILTER (nd.type = 'function') AS functions,
 count(*) FILTER (nd.type = 'class') AS classes FROM vc JOIN nd ON nd.repo = vc.repo AND nd.file = vc.path WHERE content IS NOT NULL GROUP BY ALL""",
)
CALLS_BY_LINE = _with(
    _GRAPH,
    """SELECT DISTINCT nd.repo, nd.commit_sha, nd.file, nd.start_line AS line, string_split(ed.target, '::')[-1] AS callee
FROM ed JOIN nd ON nd.repo = ed.repo AND nd.id = ed.source WHERE ed.type = 'calls' AND nd.start_line IS NOT NULL""",
)
ANNOTATED = _with(
    _GRAPH + [("raw", _RAW[1][1])],
    """SELECT r.repo, r.commit_sha, r.path, r.line, regexp_matches(any_value(r.text), '^\\s*(?:import|from)\\b') AS is_import,
 coalesce(bool_or(n.start_line = r.line), false) AS is_def, coalesce(bool_or(n.start_line = r.line AND n.type = 'class'), false) AS is_class,
 coalesce(bool_or(n.start_line = r.line OR (n.type = 'class' AND r.line BETWEEN n.start_line AND n.end_line)), false) AS is_highlighted
FROM raw r LEFT JOIN nd n ON n.repo = r.repo AND n.file = r.path AND n.start_line IS NOT NULL AND r.line BETWEEN n.start_line AND n.end_line
GROUP BY r.repo, r.commit_sha, r.path, r.line""",
)
FILE_EDGES = _with(
    _GRAPH,
    """SELECT ed.repo, ed.commit_sha, n.id AS file, ed.source, ed.target, ed.type FROM ed JOIN nd n
ON n.repo = ed.repo AND n.type = 'file' AND starts_with(ed.source, n.id)""",
)
WEIGHTS = _with(
    _TRADE + _ENTRY,
    f"""SELECT {_K}, id, round(least(greatest(base * (1 + coalesce(n, 0) / 1000.0::DOUBLE * 8) * CASE WHEN entry THEN 1.5 ELSE 1.0 END, 2.0), 20.0), 6) AS weight
FROM (SELECT gn.*, CASE type WHEN 'file' THEN 6.0::DOUBLE WHEN 'class' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END AS base, id IN (SELECT id FROM en) AS entry, i.n
 FROM gn LEFT JOIN (SELECT target, count(*) AS n FROM ge GROUP BY target) i ON i.target = gn.id)""",
)
SCALED_WEIGHTS = _with(
    _BLAST_CODE,
    """SELECT n.repo, n.commit_sha, n.id, round(least(greatest(CASE n.type WHEN 'file' THEN 6.0::DOUBLE WHEN 'class' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END
 * (1 + coalesce(n.start_line, 0) / 1000.0::DOUBLE * 8) * CASE WHEN n.is_entry_point THEN 1.5 ELSE 1.0 END, 2.0), 20.0)
 * CASE WHEN a.depth IS NULL THEN 0.4 WHEN a.depth = 0 THEN 1.8 ELSE 1 + (1 - a.depth / 6.0::DOUBLE) * 0.5 END, 6) AS weight
FROM nd n LEFT JOIN af a ON a.repo = n.repo AND a.id = n.id""",
    True,
)
INCIDENT = _with(
    _GRAPH,
    f"""SELECT * FROM ed WHERE EXISTS (SELECT 1 FROM nd WHERE nd.repo = ed.repo AND nd.type = 'class' AND nd.id IN (ed.source, ed.target))""",
)
# A point is a vertex if no two points of the chains around it turn the other
# way; only the extremes of each x matter, and there are few distinct x.
HULLS = """
WITH e AS MATERIALIZED (SELECT l_returnflag AS g, l_quantity AS x, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL),
b AS (SELECT g, min(x) AS x0, max(x) AS x1 FROM e GROUP BY g)
SELECT DISTINCT l_returnflag, x, y FROM (
SELECT g AS l_returnflag, x, lo AS y FROM e p WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e c ON a.g = c.g WHERE a.g = p.g AND a.x < p.x AND c.x > p.x
  AND (p.lo - a.lo) * (c.x - a.x) >= (c.lo - a.lo) * (p.x - a.x))
UNION ALL SELECT g, x, hi FROM e p WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e c ON a.g = c.g WHERE a.g = p.g AND a.x < p.x AND c.x > p.x
  AND (p.hi - a.hi) * (c.x - a.x) <= (c.hi - a.hi) * (p.x - a.x)))"""

EXPANDED = f"""
SELECT l_returnflag, round(x + dx / d * 28, 4) AS x, round(y + dy / d * 28, 4) AS y FROM (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM (
 SELECT l_returnflag, x, y, x - avg(x) OVER (PARTITION BY l_returnflag) AS dx, y - avg(y) OVER (PARTITION BY l_returnflag) AS dy FROM ({HULLS})))"""

# --- Events ------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'queued' ELSE 'running' END"
_JOBS = [
    (
        "je",
        f"""SELECT event_id, user_id AS job_id, ts, {_STATUS} AS status, CAST(event_id % 100 AS INTEGER) AS progress, event_type AS stage, props AS message,
 CASE WHEN event_type = 'error' THEN props END AS error, trim(string_split(concat(user_id % 20, ' , 10.0.0.1'), ',')[1]) AS client FROM events""",
    ),
    ("js", "SELECT * FROM je QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1"),
]
LATEST_STATE = _with(
    _JOBS,
    "SELECT job_id, epoch_us(ts) AS ts, status, progress, stage, message, error, status IN ('done', 'error') AS terminal FROM js",
)
UNEXPIRED = """
SELECT concat_ws('-', user_id, strftime(ts, '%Y-%m-%d')) AS job_id, epoch_us(min(ts)) AS created_at FROM events
GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 240 HOUR"""
ACTIVE = _with(
    _JOBS,
    """SELECT client, count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (status IN ('queued', 'running')) >= 5 AS limited
FROM js GROUP BY client""",
)
ACTIVE_TOTAL = _with(_JOBS, "SELECT count(*) FILTER (status IN ('queued', 'running')) AS active_jobs FROM js")
REMAINING = _with(
    _JOBS,
    """SELECT job_id, status, progress, CASE WHEN status IN ('running', 'queued') AND progress > 5 AND job_id % 90 > 0
 THEN CAST(ceil((100 - progress) / (progress / (job_id % 90))) AS BIGINT) END AS remaining FROM js""",
)
TRAILING = """
SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS load FROM events"""
_HOUR = 3_600_000_000
_START = 1_700_000_000_000_000  # keeps time and id in one sortable number
RATE_LIMITED_USERS = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT event_id, concat('impact_', user_id) AS client, (epoch_us(ts) - {_START}) * 100000 + event_id AS o, epoch_us(ts) - {_START} AS at FROM events),
a AS (SELECT client, min(o) AS o FROM v GROUP BY client
 UNION ALL SELECT a.client, (SELECT min(v.o) FROM v WHERE v.client = a.client AND v.at >= a.o // 100000 + {6 * _HOUR}) AS o FROM a WHERE a.o IS NOT NULL)
SELECT event_id, client, o IN (SELECT o FROM a WHERE o IS NOT NULL) AS accepted FROM v"""
RATE_LIMITED = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT event_id, event_type, (epoch_us(ts) - {_START}) * 100000 + event_id AS o, epoch_us(ts) - {_START} AS at FROM events),
a AS (SELECT event_type, CAST(NULL AS BIGINT) AS p, min(o) AS o FROM v GROUP BY event_type
 UNION ALL SELECT a.event_type, a.o AS p, (SELECT min(v.o) FROM v WHERE v.event_type = a.event_type AND v.o > a.o
   AND (a.p IS NULL OR v.at >= a.p // 100000 + {_HOUR})) AS o FROM a WHERE a.o IS NOT NULL)
SELECT event_id, event_type, o IN (SELECT o FROM a WHERE o IS NOT NULL) AS accepted FROM v"""
RATE_LIMITED_CLIENTS = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT event_id, concat('chat_', user_id) AS client, (epoch_us(ts) - {_START}) * 100000 + event_id AS o, epoch_us(ts) - {_START} AS at FROM events),
a AS (SELECT client, CAST(NULL AS BIGINT) AS p, min(o) AS o FROM v GROUP BY client
 UNION ALL SELECT a.client, a.o AS p, (SELECT min(v.o) FROM v WHERE v.client = a.client AND v.o > a.o
   AND (a.p IS NULL OR v.at >= a.p // 100000 + {24 * _HOUR})) AS o FROM a WHERE a.o IS NOT NULL)
SELECT event_id, client, o IN (SELECT o FROM a WHERE o IS NOT NULL) AS accepted FROM v"""
