"""Fixed values and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the analysed system's for right results) -------

EXCLUDED_PATH_TERMS = (
    "test", "tests", "migrations", "__pycache__", ".venv", "node_modules", "setup.py", "conftest.py",
)
MAX_FILE_BYTES = 100_000
MAX_FILES_PER_REPO = 60

SECRET_RULES = (  # first match per line wins, case-insensitive
    ("password", r"""(password|passwd|pwd)\s*=\s*["'][^"']{4,}["']"""),
    ("api_key", r"""(api_key|apikey|api_secret)\s*=\s*["'][^"']{8,}["']"""),
    ("secret_key", r"""(secret_key|secret)\s*=\s*["'][^"']{8,}["']"""),
    ("token", r"""(token)\s*=\s*["'][^"']{10,}["']"""),
    ("aws_key", r"""(aws_access_key_id|aws_secret)\s*=\s*["']"""),
)
SECRET_EXCLUDED_TERMS = (
    "example", "placeholder", "your_", "YOUR_", "<", ">", "os.getenv", "os.environ", "config.",
)
SQL_INJECTION_PATTERN = r"""execute\s*\(\s*f["']|execute\s*\(\s*["'].*\+.*["']"""
EVAL_PATTERN = r"\beval\s*\("
DEBUG_PATTERNS = (r"\bpdb\.set_trace\(\)", r"\bbreakpoint\(\)", r"""\bprint\s*\(\s*["']DEBUG""")
TODO_PATTERN = r"#\s*(TODO|FIXME|HACK|XXX|BUG)[\s:](.*)"
TODO_CHARS = 60

MESSAGES = {
    "secret": "Possible hardcoded %s detected",
    "sql": "Potential SQL injection via string formatting",
    "eval": "Use of eval() — arbitrary code execution risk",
    "debug": "Debug statement left in production code",
    "todo": "TODO/FIXME comment: %s",
    "long": "Function %s is %s lines — consider breaking it up",
    "params": "Function %s has %s parameters — may indicate poor design",
    "docs": "%s public functions missing docstrings",
    "god": "Class %s has %s methods — possible God Object anti-pattern",
    "cycle": "Circular import: %s ↔ %s",
    "dead": "Function %s appears to be unused",
}

PATTERN_TEXT = {
    "Singleton": "Ensures a class has only one instance and provides a global point of access to it.",
    "Factory": "Creates objects without specifying the exact class to create.",
    "Repository": "Mediates between the domain and data mapping layers using a collection-like interface.",
    "Context Manager": "Implements the context management protocol (__enter__, __exit__) for resource management.",
    "Factory function": "Function acting as a factory to create and return objects.",
    "Decorator": "Function that modifies the behavior of another function.",
}
SINGLETON_METHODS = ("get_instance", "getInstance")
SINGLETON_VARIABLE = "_instance"
REPOSITORY_METHODS = ("get", "find", "save", "delete", "update", "list")
CONTEXT_METHODS = ("__enter__", "__exit__")
DECORATOR_PARAMETERS = ("func", "fn", "decorated")
USED_BY_CONVENTION = ("main", "__init__", "__str__", "__repr__", "__eq__")

LONG_FUNCTION_LINES = 50
MANY_PARAMETERS = 6
MISSING_DOCS_RATIO = 0.3
GOD_OBJECT_METHODS = 15
REPOSITORY_OVERLAP = 3

BLAST_SEVERITIES = ("critical", "high", "medium", "low")
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
LAST_GRADE = "F"
RISK_LEVELS = ("SAFE", "CAUTION", "RISKY", "DANGEROUS")
DEFAULT_RISK = "CAUTION"
EDGE_TYPES = ("defines", "calls", "imports")  # a later type replaces an earlier one on the same pair

ITEMS_PER_PROMPT = 25
SUMMARY_WORDS = 30
OUTLINE_FILES = 40
OUTLINE_ENTRIES = 10
OUTLINE_CALLS = 50
HISTORY_MESSAGES = 6

# Words of the Python language that may stand before an opening bracket.
PYTHON_KEYWORDS = (
    "and", "as", "assert", "async", "await", "class", "def", "del", "elif", "else", "except", "finally",
    "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass",
    "raise", "return", "try", "while", "with", "yield", "None", "True", "False",
)

# --- Schemas -----------------------------------------------------------------

_KEY = [T.StructField("repo", T.StringType()), T.StructField("commit_sha", T.StringType())]
_STRS = T.ArrayType(T.StringType())

FILES = T.StructType(_KEY + [T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])

NODES = T.StructType(_KEY + [
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
])

EDGES = T.StructType(_KEY + [
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("type", T.StringType()),
])

ISSUES = T.StructType(_KEY + [
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("rule", T.IntegerType()),
])

PATTERNS = T.StructType(_KEY + [
    T.StructField("name", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("rule", T.IntegerType()),
])

# The questions that a chat offers, the fences that answers come in, and what an address looks like.
SUGGESTED_QUESTIONS = (
    "Explain the overall architecture of this project",
    "What are the entry points and how do they connect?",
    "What does `%s` do and what calls it?",
    "How does `%s` relate to `%s`?",
)
FENCE_START, FENCE_END = r"^```(?:json)?\s*", r"\s*```\s*$"
ADDRESS = r"^(?:https?://)?(?:www\.)?{host}/([^/]+)/([^/]+)$"
