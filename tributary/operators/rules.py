"""Line rules: security and quality findings in one pass over the text.

The rule table is fixed, so its patterns become literals of the plan: each is
compiled once per task, and a cheap ``contains`` test spares most lines the
regular expression.  Lines are read, tested and dropped inside one narrow
stage; only findings leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import is_comment, is_test_path, strip
from tributary.schemas import (
    DEBUG_PATTERNS,
    EVAL_PATTERN,
    MESSAGES,
    SECRET_EXCLUDED_TERMS,
    SECRET_RULES,
    SQL_INJECTION_PATTERN,
    TODO_CHARS,
    TODO_PATTERN,
)
from tributary.session import KEYS, require


def lines(files: DataFrame, keys: Sequence[str] = KEYS, content: str = "content") -> DataFrame:
    """``(keys, path, line, text)``: every line of every file, from 1.

    Files with blank or missing content yield nothing.
    """
    require(files, [*keys, "path", content], "lines")
    return (
        files.filter(F.col(content).rlike(r"\S"))
        .select(*keys, "path", F.posexplode_outer(F.split(content, "\n")).alias("_pos", "text"))
        .select(*keys, "path", (F.col("_pos") + 1).alias("line"), "text")
    )


def secret_kind(text: Column) -> Column:
    """Name of the first secret rule a line matches, else null."""
    excluded = F.lit(False)
    for term in SECRET_EXCLUDED_TERMS:
        excluded = excluded | F.contains(text, F.lit(term))
    kind = F.when(F.lit(False), F.lit(""))
    for name, pattern in SECRET_RULES:
        kind = kind.when(text.rlike("(?id)" + pattern), name)
    quoted = F.contains(text, F.lit("=")) & (F.contains(text, F.lit('"')) | F.contains(text, F.lit("'")))
    return F.when(quoted & ~excluded & ~is_comment(text), kind)


def _finding(rule: int, severity: str, kind: str, message: Column, when: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(severity).alias("severity"),
            F.lit(kind).alias("type"),
            message.alias("message"),
            F.lit(rule).alias("rule"),
        ),
    )


def secret_finding(text: Column, path: Column) -> Column:
    kind = secret_kind(text)
    before, after = MESSAGES["secret"].split("%s")
    return _finding(1, "high", "security", F.concat(F.lit(before), kind, F.lit(after)), kind.isNotNull())


def sql_injection_finding(text: Column, path: Column) -> Column:
    hit = F.contains(text, F.lit("execute")) & text.rlike("(?d)" + SQL_INJECTION_PATTERN) & ~is_comment(text)
    return _finding(2, "high", "security", F.lit(MESSAGES["sql"]), hit)


def eval_finding(text: Column, path: Column) -> Column:
    hit = F.contains(text, F.lit("eval")) & text.rlike(EVAL_PATTERN) & ~is_comment(text)
    return _finding(3, "high", "security", F.lit(MESSAGES["eval"]), hit)


def debug_finding(text: Column, path: Column) -> Column:
    hit = F.contains(text, F.lit("(")) & text.rlike("|".join(DEBUG_PATTERNS)) & ~is_comment(text) & ~is_test_path(path)
    return _finding(4, "medium", "quality", F.lit(MESSAGES["debug"]), hit)


def todo_finding(text: Column, path: Column) -> Column:
    pattern = "(?id)" + TODO_PATTERN
    note = F.substring(strip(F.regexp_extract(text, pattern, 2)), 1, TODO_CHARS)
    before, _ = MESSAGES["todo"].split("%s")
    hit = F.contains(text, F.lit("#")) & text.rlike(pattern)
    return _finding(5, "low", "quality", F.concat(F.lit(before), note), hit)


ALL_RULES = (secret_finding, sql_injection_finding, eval_finding, debug_finding, todo_finding)


def scan(
    lines: DataFrame, rules: Sequence = ALL_RULES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Findings of the given rules over ``lines``, as issue rows."""
    require(lines, [*keys, "path", "line", "text"], "scan")
    found = [rule(F.col("text"), F.col("path")) for rule in rules]
    return (
        lines.select(*keys, "path", "line", F.explode_outer(F.array_compact(F.array(*found))).alias("f"))
        .filter(F.col("f").isNotNull())
        .select(
            *keys,
            F.col("path").alias("file"),
            "line",
            "f.severity",
            "f.type",
            "f.message",
            F.lit(None).cast("string").alias("function"),
            "f.rule",
        )
    )
