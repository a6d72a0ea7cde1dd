"""Rollups of findings: per file, per node and per repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import severity_name, severity_rank
from tributary.operators.structure import length
from tributary.schemas import GRADES, LAST_GRADE
from tributary.session import KEYS, salted_join


def file_issues(issues: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Issue count and worst severity per file; the issues stay rows."""
    return (
        issues.groupBy(*keys, "file")
        .agg(F.count(F.lit(1)).alias("issue_count"), F.max(severity_rank(F.col("severity"))).alias("_rank"))
        .select(*keys, "file", "issue_count", severity_name(F.col("_rank")).alias("severity"))
    )


def badge_nodes(nodes: DataFrame, per_file: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every node with the issue count and worst severity of its file."""
    badge = per_file.select(*keys, "file", "issue_count", F.col("severity").alias("issue_severity"))
    return nodes.join(badge, [*keys, "file"], "left").withColumn(
        "issue_count", F.coalesce("issue_count", F.lit(0).cast("long"))
    )


def severity_totals(issues: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return issues.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")]
    )


def ranked_files(per_file: DataFrame) -> DataFrame:
    """Files with the worst severity first, then by path."""
    return per_file.orderBy(severity_rank(F.col("severity")).desc(), "file")


def issues_in_files(
    issues: DataFrame, per_file: DataFrame, severity: str | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Issues with their file's severity, optionally of one severity only.

    The filter drops issues, and with them files that keep none; the file's
    own severity does not change.  A file with very many issues is split by the
    skew handling of adaptive joins.
    """
    kept = issues if severity is None else issues.filter(F.col("severity") == severity)
    group = per_file.select(*keys, "file", F.col("severity").alias("file_severity"))
    return kept.join(group, [*keys, "file"])


def grade(score: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for bound, letter in GRADES:
        out = out.when(score >= bound, letter)
    return out.otherwise(LAST_GRADE)


def node_metrics(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals, function lengths and the test share of each repository."""
    is_function = F.col("type") == "function"
    n = F.when(is_function, length())
    is_test = is_function & (F.startswith("label", F.lit("test_")) | F.contains("file", F.lit("test")))
    return nodes.groupBy(*keys).agg(
        F.count_if(F.col("type") == "file").alias("total_files"),
        F.count_if(is_function).alias("total_functions"),
        F.count_if(F.col("type") == "class").alias("total_classes"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_length"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_function_length"),
        F.count_if(is_test).alias("test_functions"),
    )


def most_complex_file(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The file with most functions and classes; the first path on a tie."""
    per_file = (
        nodes.filter(F.col("type").isin("function", "class")).groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("symbols"))
    )
    top = per_file.groupBy(*keys).agg(F.max("symbols").alias("symbols"))
    return (
        salted_join(per_file, top, [*keys, "symbols"], "left_semi", ["file"])
        .groupBy(*keys)
        .agg(F.min("file").alias("most_complex_file"))
    )


def coverage(metrics: DataFrame) -> Column:
    return F.when(F.col("total_functions") > 0, F.round(F.col("test_functions") / F.col("total_functions"), 2)).otherwise(0.0)


def health(
    nodes: DataFrame,
    issues: DataFrame,
    patterns: DataFrame,
    keys: Sequence[str] = KEYS,
    circular_divisor: int = 1,
) -> DataFrame:
    """Score, grade and metrics, one row per repository.

    Three grouped aggregates meet on the repository key, so no row-level join
    is involved.  A pair of files importing each other is one cycle;
    ``circular_divisor=2`` halves the count.
    """
    keys = list(keys)
    per_issue = issues.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
        F.count_if(F.col("type") == "dead_code").alias("dead_code_count"),
        (F.count_if(F.contains("message", F.lit("Circular import"))) / circular_divisor).alias("circular"),
    )
    per_pattern = patterns.groupBy(*keys).agg(F.count(F.lit(1)).alias("pattern_count"))
    joined = (
        node_metrics(nodes, keys)
        .join(per_issue, keys, "left")
        .join(per_pattern, keys, "left")
        .join(most_complex_file(nodes, keys), keys, "left")
        .na.fill(0, ["high", "medium", "low", "dead_code_count", "pattern_count"])
        .na.fill(0.0, ["circular"])
    )
    functions = F.col("total_functions")
    mean = F.when(functions > 0, F.col("total_length") / functions).otherwise(0.0)
    raw = (
        F.lit(100)
        - 8 * F.col("high")
        - 3 * F.col("medium")
        - F.col("low")
        + 2 * F.col("pattern_count")
        - 10 * F.col("circular")
        - F.when((functions > 0) & (F.col("dead_code_count") / functions > 0.2), 10).otherwise(0)
        - F.when(mean > 40, 5).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int")))
    return joined.select(
        *keys,
        score.alias("score"),
        grade(score).alias("grade"),
        "total_files",
        "total_functions",
        "total_classes",
        F.round(mean, 1).alias("avg_function_length"),
        "max_function_length",
        "most_complex_file",
        "dead_code_count",
        F.col("circular").cast("int").alias("circular_import_count"),
        coverage(joined).alias("test_coverage_estimate"),
    )


def issue_nodes(issues: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The node an issue points to: its function in the file, else the file."""
    keys = list(keys)
    by_name = (
        nodes.select(*keys, "file", F.col("label").alias("function"), "id")
        .groupBy(*keys, "file", "function")
        .agg(F.min("id").alias("_named"))
    )
    file_ids = nodes.filter(F.col("type") == "file").select(*keys, F.col("id").alias("file"), F.lit(True).alias("_known"))
    joined = issues.join(by_name, [*keys, "file", "function"], "left")
    joined = joined.join(file_ids, [*keys, "file"], "left")
    node = F.coalesce("_named", F.when(F.col("_known"), F.col("file")))
    return joined.select(*keys, "file", "line", "message", "function", node.alias("node_id"))
