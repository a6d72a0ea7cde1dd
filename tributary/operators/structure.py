"""Findings and patterns from symbols and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.schemas import (
    CONTEXT_METHODS,
    DECORATOR_PARAMETERS,
    GOD_OBJECT_METHODS,
    LONG_FUNCTION_LINES,
    MANY_PARAMETERS,
    MESSAGES,
    MISSING_DOCS_RATIO,
    PATTERN_TEXT,
    REPOSITORY_METHODS,
    REPOSITORY_OVERLAP,
    SINGLETON_METHODS,
    SINGLETON_VARIABLE,
    USED_BY_CONVENTION,
)
from tributary.session import KEYS


def _message(name: str, *values: Column) -> Column:
    texts = MESSAGES[name].split("%s")
    parts: list[Column] = []
    for text, value in zip(texts, [*values, None]):
        if text:
            parts.append(F.lit(text))
        if value is not None:
            parts.append(value.cast("string"))
    return F.concat(*parts)


def _issues(
    df: DataFrame, keys: Sequence[str], rule: int, file: str, line: Column, severity: str, kind: str, message: Column, function: Column | None = None
) -> DataFrame:
    return df.select(
        *keys,
        F.col(file).alias("file"),
        line.cast("int").alias("line"),
        F.lit(severity).alias("severity"),
        F.lit(kind).alias("type"),
        message.alias("message"),
        (F.lit(None).cast("string") if function is None else function).alias("function"),
        F.lit(rule).alias("rule"),
    )


def length(df_start: str = "start_line", df_end: str = "end_line") -> Column:
    """Length of a definition: end minus start, one less than its lines."""
    return F.coalesce(F.col(df_end) - F.col(df_start), F.lit(0))


def long_functions(nodes: DataFrame, keys: Sequence[str] = KEYS, limit: int = LONG_FUNCTION_LINES) -> DataFrame:
    n = length()
    return _issues(
        nodes.filter((F.col("type") == "function") & (n > limit)),
        keys, 6, "file", F.col("start_line"), "medium", "quality", _message("long", F.col("label"), n), F.col("label"),
    )


def many_parameters(functions: DataFrame, keys: Sequence[str] = KEYS, limit: int = MANY_PARAMETERS) -> DataFrame:
    n = F.size("parameters")
    return _issues(
        functions.filter(n > limit),
        keys, 7, "path", F.col("start_line"), "medium", "quality", _message("params", F.col("name"), n), F.col("name"),
    )


def missing_docstrings(functions: DataFrame, keys: Sequence[str] = KEYS, ratio: float = MISSING_DOCS_RATIO) -> DataFrame:
    """Files whose public plain functions too often lack a docstring."""
    public = ~F.startswith(F.col("name"), F.lit("_")) & ~F.col("is_method")
    per_file = (
        functions.filter(public)
        .groupBy(*keys, "path")
        .agg(F.count(F.lit(1)).alias("public"), F.count_if(F.col("docstring").isNull()).alias("missing"))
        .filter(F.col("missing") / F.col("public") > ratio)
    )
    return _issues(per_file, keys, 8, "path", F.lit(1), "low", "quality", _message("docs", F.col("missing")))


def god_objects(classes: DataFrame, keys: Sequence[str] = KEYS, limit: int = GOD_OBJECT_METHODS) -> DataFrame:
    n = F.size("method_names")
    return _issues(
        classes.filter(n > limit), keys, 9, "path", F.col("start_line"), "medium", "quality", _message("god", F.col("name"), n)
    )


def import_cycles(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of files that import each other, reported at the smaller path.

    Both directions of a pair share one unordered key, so a grouped count
    finds the cycles without joining the edges to themselves.
    """
    pair = [*keys, "a", "b"]
    both = (
        edges.filter((F.col("type") == "imports") & (F.col("source") != F.col("target")))
        .select(*keys, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).alias("up"))
        .groupBy(*pair)
        .agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
        .filter(F.col("up") & F.col("down"))
    )
    return _issues(both, keys, 10, "a", F.lit(1), "medium", "quality", _message("cycle", F.col("a"), F.col("b")))


def dead_code(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, edge_types: Sequence[str] = ("calls",)
) -> DataFrame:
    """Functions nothing leads to over the given edge types.

    Private, test and conventional names are left out.  With all edge types
    every function is defined by its file and none is dead.
    """
    used = edges.filter(F.col("type").isin(*edge_types)).select(*keys, F.col("target").alias("id"))
    return _dead(nodes.filter(F.col("type") == "function").join(used, [*keys, "id"], "left_anti"), keys)


def dead_flagged(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Like :func:`dead_code` over calls, for nodes that know whether they are
    entry points: those are the functions nothing calls."""
    return _dead(nodes.filter("is_entry_point"), keys)


def _dead(unused: DataFrame, keys: Sequence[str]) -> DataFrame:
    name = F.col("label")
    open_names = (
        ~F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("test_")) & ~name.isin(*USED_BY_CONVENTION)
    )
    return _issues(
        unused.filter(open_names), keys, 11, "file", F.coalesce("start_line", F.lit(1)), "low", "dead_code", _message("dead", name), name
    )


def _any_of(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _makes(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("factory")) | F.startswith(name, F.lit("create_"))


def _is_singleton() -> Column:
    return F.arrays_overlap("method_names", _any_of(SINGLETON_METHODS)) | F.array_contains(
        "class_variables", SINGLETON_VARIABLE
    )


def _is_factory_class() -> Column:
    return F.contains(F.lower("name"), F.lit("factory")) | F.exists("method_names", _makes)


def _is_repository() -> Column:
    return F.size(F.array_intersect("method_names", _any_of(REPOSITORY_METHODS))) >= REPOSITORY_OVERLAP


def _is_context_manager() -> Column:
    first, second = (F.array_contains("method_names", m) for m in CONTEXT_METHODS)
    return first & second


def _is_factory_function() -> Column:
    return _makes(F.col("name"))


def _is_decorator() -> Column:
    return F.arrays_overlap("parameters", _any_of(DECORATOR_PARAMETERS))


# (order, pattern, description, condition)
_CLASS_PATTERNS = (
    (1, "Singleton", "Singleton", _is_singleton),
    (2, "Factory", "Factory", _is_factory_class),
    (3, "Repository", "Repository", _is_repository),
    (4, "Context Manager", "Context Manager", _is_context_manager),
)
_FUNCTION_PATTERNS = (
    (5, "Factory", "Factory function", _is_factory_function),
    (6, "Decorator", "Decorator", _is_decorator),
)


def _patterns(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple]) -> DataFrame:
    """All wanted patterns of each symbol, found in one pass."""
    found = [
        F.when(
            test(),
            F.struct(F.lit(name).alias("name"), F.lit(PATTERN_TEXT[text]).alias("description"), F.lit(rule).alias("rule")),
        )
        for rule, name, text, test in wanted
    ]
    rows = df.select(
        *keys, F.col("path").alias("file"), F.col("name").alias("class"), F.explode_outer(F.array_compact(F.array(*found))).alias("p")
    )
    return rows.filter(F.col("p").isNotNull()).select(*keys, "p.name", "file", "class", "p.description", "p.rule")


def class_patterns(classes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _patterns(classes, keys, _CLASS_PATTERNS)


def function_patterns(functions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every function counts, methods included."""
    return _patterns(functions, keys, _FUNCTION_PATTERNS)


def singletons(classes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _patterns(classes, keys, _CLASS_PATTERNS[:1])


def factory_classes(classes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _patterns(classes, keys, _CLASS_PATTERNS[1:2])


def repositories(classes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _patterns(classes, keys, _CLASS_PATTERNS[2:3])


def context_managers(classes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _patterns(classes, keys, _CLASS_PATTERNS[3:])


def factory_functions(functions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _patterns(functions, keys, _FUNCTION_PATTERNS[:1])


def decorator_functions(functions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _patterns(functions, keys, _FUNCTION_PATTERNS[1:])


def unique_patterns(patterns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first of equal (name, file, class), in rule order."""
    return (
        patterns.groupBy(*keys, "name", "file", "class")
        .agg(F.min_by("description", "rule").alias("description"))
        .select(*keys, "name", "file", "class", "description")
    )


def unique_issues(issues: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first of equal (file, line, message), with a reproducible id."""
    return (
        issues.groupBy(*keys, "file", "line", "message")
        .agg(F.min_by(F.struct("severity", "type", "function"), "rule").alias("i"))
        .select(
            *keys,
            F.sha2(F.concat_ws("|", "file", F.col("line").cast("string"), "message"), 256).alias("id"),
            "file",
            "line",
            "i.severity",
            "i.type",
            "message",
            "i.function",
        )
    )
