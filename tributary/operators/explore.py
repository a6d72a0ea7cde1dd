"""Exploration queries over the graph and its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import last_segment, top_directory
from tributary.session import KEYS, first_k, telling_first


def search_nodes(nodes: DataFrame, term: str, limit: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """First matches of each repository, by id, of a term in label or file, ignoring case."""
    needle = F.lit(term.lower())
    hit = F.contains(F.lower("label"), needle) | F.coalesce(F.contains(F.lower("file"), needle), F.lit(False))
    return first_k(nodes.filter(hit).select(*keys, "id", "label", "type", "file"), keys, ["id"], limit).drop("rank")


def call_neighbours(nodes: DataFrame, edges: DataFrame, limit: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(id, direction, rank, other, label, hidden)``: first callers and
    callees of every node that are known nodes, and how many stay hidden."""
    keys = list(keys)
    calls = edges.filter(F.col("type") == "calls")
    rows = calls.select(
        *keys, F.col("target").alias("id"), F.lit("caller").alias("direction"), F.col("source").alias("other")
    ).unionByName(
        calls.select(*keys, F.col("source").alias("id"), F.lit("callee").alias("direction"), F.col("target").alias("other"))
    )
    ids = nodes.select(*keys, F.col("id").alias("other"), "label")
    known = rows.join(ids, telling_first([*keys, "other"]))
    known = known.join(nodes.select(*keys, "id"), telling_first([*keys, "id"]), "left_semi")
    group = [*keys, "id", "direction"]
    top = first_k(known, group, ["other"], limit)
    counts = known.groupBy(*group).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("hidden"))
    return top.join(counts, telling_first(group)).select(*group, "rank", "other", "label", "hidden")


def degrees(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """In and out degree of every node over all edge types.

    Ends of edges and nodes form one table, so a single grouped sum with
    partial aggregation replaces two joins.
    """
    ends = edges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e"),
    ).select(*keys, "e.id", "e.i", "e.o", F.lit(0).alias("known"))
    own = nodes.select(*keys, "id", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("known"))
    return (
        ends.unionByName(own)
        .groupBy(*keys, "id")
        .agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.max("known").alias("known"))
        .filter("known = 1")
        .drop("known")
    )


def directory_groups(nodes: DataFrame, keys: Sequence[str] = KEYS, least: int = 2) -> DataFrame:
    """Nodes per top-level directory, single-node directories left out."""
    folder = top_directory(F.coalesce(F.nullif(F.col("file"), F.lit("")), F.col("id")))
    return (
        nodes.groupBy(*keys, folder.alias("dir"))
        .agg(F.count(F.lit(1)).alias("nodes"))
        .filter(F.col("nodes") >= least)
    )


def first_directories(groups: DataFrame, limit: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """First groups by name and the count of the rest.

    ``(rank, dir, nodes, more)``; ``more`` is the same on each row.
    """
    counts = groups.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    return first_k(groups, keys, ["dir"], limit).join(counts, list(keys)).select(*keys, "rank", "dir", "nodes", "more")


def _prefixes(path: str):
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i == F.size(parts)).alias("is_file")),
    )


def directory_tree(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every directory and file with function and class counts below it.

    ``(path, parent, name, depth, is_file, files, functions, classes)``.
    Symbols are counted per file before the path prefixes multiply the rows.
    """
    per_file = nodes.groupBy(*keys, "file").agg(
        F.count_if(F.col("type") == "file").alias("files"),
        F.count_if(F.col("type") == "function").alias("functions"),
        F.count_if(F.col("type") == "class").alias("classes"),
    ).filter("files > 0")
    rows = per_file.select(*keys, F.explode(_prefixes("file")).alias("p"), "files", "functions", "classes")
    return (
        rows.groupBy(*keys, "p.path", "p.is_file")
        .agg(F.sum("files").alias("files"), F.sum("functions").alias("functions"), F.sum("classes").alias("classes"))
        .select(
            *keys,
            "path",
            F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"),
            last_segment(F.col("path"), "/").alias("name"),
            F.size(F.split("path", "/")).alias("depth"),
            "is_file",
            "files",
            "functions",
            "classes",
        )
    )


def listing_order(tree: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The tree as listed: per parent, directories first, then by name."""
    return tree.orderBy(*keys, "parent", "is_file", "name")


def search_tree(tree: DataFrame, term: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Files whose path contains the term, with all their ancestors."""
    hit = tree.filter(F.col("is_file") & F.contains(F.lower("path"), F.lit(term.lower())))
    return hit.select(*keys, F.explode(_prefixes("path")).alias("p")).select(*keys, "p.path", "p.is_file").distinct()


def file_symbols(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Functions and classes of each file by start line."""
    return (
        nodes.filter(F.col("type").isin("function", "class"))
        .select(*keys, "file", "start_line", "id", "label", "type")
        .orderBy(*keys, "file", "start_line", "id")
    )


def type_totals(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return nodes.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("nodes"))


def file_totals(files: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Functions, classes and lines of every file with content."""
    counts = nodes.groupBy(*keys, F.col("file").alias("path")).agg(
        F.count_if(F.col("type") == "function").alias("functions"),
        F.count_if(F.col("type") == "class").alias("classes"),
    )
    lines = files.filter(F.length("content") > 0).select(*keys, "path", F.size(F.split("content", "\n")).alias("lines"))
    return lines.join(counts, [*keys, "path"], "left").na.fill(0, ["functions", "classes"])


def calls_by_definition(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(file, line, callee)``: short names called from each definition line."""
    keys = list(keys)
    callers = nodes.filter(F.col("start_line").isNotNull()).select(
        *keys, F.col("id").alias("source"), "file", F.col("start_line").alias("line")
    )
    calls = edges.filter(F.col("type") == "calls").select(
        *keys, "source", last_segment(F.col("target"), "::").alias("callee")
    ).distinct()
    return calls.join(callers, [*keys, "source"]).select(*keys, "file", "line", "callee").distinct()


def annotate_lines(
    lines: DataFrame, nodes: DataFrame, selected: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Flags of every line: import, definition, class, highlighted.

    ``selected(id)`` marks nodes whose whole body is highlighted; of other
    nodes only the definition line is.  A sweep over each file: a body is a
    mark where it starts and one behind its end, marks and lines are merged by
    line number, and a running sum tells what lies inside.  Lines and marks
    meet in one exchange, which carries no text.
    """
    from pyspark.sql import Window

    keys = list(keys)
    file = [*keys, "path"]
    spans = nodes.filter(F.col("start_line").isNotNull()).select(
        *keys, "id", F.col("file").alias("path"), "type", "start_line", "end_line"
    )
    if selected is None:
        spans = spans.withColumn("_chosen", F.lit(0))
    else:
        chosen = selected.select(*keys, "id").distinct().withColumn("_chosen", F.lit(1))
        spans = spans.join(chosen, [*keys, "id"], "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(0)))

    def mark(line, step, is_def, is_class):
        return F.struct(line.alias("line"), step.alias("step"), is_def.alias("is_def"), is_class.alias("is_class"))

    ends = [
        mark(F.col("start_line"), F.col("_chosen"), F.lit(True), F.col("type") == "class"),
        mark(F.col("end_line") + 1, -F.col("_chosen"), F.lit(False), F.lit(False)),
    ]
    marks = (
        spans.select(*file, F.explode(F.array(*ends)).alias("m"))
        .filter(F.col("m.line").isNotNull())
        .groupBy(*file, F.col("m.line").alias("line"))
        .agg(F.sum("m.step").alias("_step"), F.bool_or("m.is_def").alias("_def"), F.bool_or("m.is_class").alias("_class"))
    )
    flags = lines.select(*file, "line", F.col("text").rlike(r"^\s*(?:import|from)\b").alias("is_import"), F.lit(1).alias("_own"))
    swept = Window.partitionBy(*file).orderBy("line", "_own").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_own") == 0, F.struct("line", "_def", "_class")), ignorenulls=True)
    merged = (
        flags.unionByName(marks.withColumn("_own", F.lit(0)), allowMissingColumns=True)
        .withColumns({"_open": F.sum(F.coalesce("_step", F.lit(0))).over(swept), "_last": last.over(swept)})
        .filter("_own = 1")
    )
    here = F.coalesce(F.col("_last.line") == F.col("line"), F.lit(False))
    is_def = here & F.coalesce("_last._def", F.lit(False))
    return merged.select(
        *file,
        "line",
        "is_import",
        is_def.alias("is_def"),
        (here & F.coalesce("_last._class", F.lit(False))).alias("is_class"),
        (is_def | (F.col("_open") > 0)).alias("is_highlighted"),
    )


def file_edges(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, suffix: str | None = None
) -> DataFrame:
    """``(file, source, target, type)``: edges whose source id starts with the
    path of a file.

    The prefix test becomes an equality: each source id yields its prefixes,
    and those meet the file nodes.  If all files are known to end in
    ``suffix``, only prefixes that do are tried.
    """
    keys = list(keys)
    files = nodes.filter(F.col("type") == "file").select(*keys, F.col("id").alias("file"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("source")), lambda n: F.substr("source", F.lit(1), n))
    if suffix is not None:
        prefixes = F.filter(prefixes, lambda p: F.endswith(p, F.lit(suffix)))
    return (
        edges.select(*keys, "source", "target", "type", F.explode_outer(prefixes).alias("file"))
        .join(files, [*keys, "file"], "left_semi")
        .select(*keys, "file", "source", "target", "type")
    )


def node_weights(nodes: DataFrame, affected: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Display weight of nodes, scaled by one change's impact if given."""
    base = F.when(F.col("type") == "file", 6.0).when(F.col("type") == "class", 5.0).otherwise(3.0)
    size = base * (1 + F.coalesce("centrality", F.lit(0.0)) * 8) * F.when(F.col("is_entry_point"), 1.5).otherwise(1.0)
    weighted = nodes.withColumn("weight", F.least(F.greatest(size, F.lit(2.0)), F.lit(20.0)))
    if affected is None:
        return weighted.select(*keys, "id", "weight")
    hit = affected.select(*keys, "id", "depth")
    scale = (
        F.when(F.col("depth").isNull(), 0.4)
        .when(F.col("depth") == 0, 1.8)
        .otherwise(1 + (1 - F.col("depth") / 6) * 0.5)
    )
    return weighted.join(hit, [*keys, "id"], "left").select(*keys, "id", (F.col("weight") * scale).alias("weight"))


def incident_edges(edges: DataFrame, highlighted: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges that touch a highlighted node; without a set, all edges."""
    if highlighted is None:
        return edges
    keys = list(keys)
    ids = highlighted.select(*keys, "id").distinct()
    marked = edges.join(
        ids.select(*keys, F.col("id").alias("source"), F.lit(True).alias("_s")), [*keys, "source"], "left"
    ).join(ids.select(*keys, F.col("id").alias("target"), F.lit(True).alias("_t")), [*keys, "target"], "left")
    return marked.filter(F.col("_s") | F.col("_t")).select(*keys, "source", "target", "type")
