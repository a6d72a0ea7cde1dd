"""The dependency graph: nodes, edges, name resolution, entry points."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import last_segment
from tributary.operators.tiling import TILE, tiled_join
from tributary.schemas import EDGE_TYPES
from tributary.session import KEYS, require, telling_first


def nodes(files: DataFrame, classes: DataFrame, functions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """File, class and function nodes, one row per id.

    Definitions of one file that share a name share an id: a function replaces
    a class, and the later definition replaces the earlier one.
    """
    def rows(df: DataFrame, kind: str, order: int) -> DataFrame:
        symbol = kind != "file"
        return df.select(
            *keys,
            (F.col("id") if symbol else F.col("path")).alias("id"),
            (F.col("name") if symbol else F.col("path")).alias("label"),
            F.lit(kind).alias("type"),
            F.col("path").alias("file"),
            F.lit("").alias("summary"),
            (F.col("start_line") if symbol else F.lit(None).cast("int")).alias("start_line"),
            (F.col("end_line") if symbol else F.lit(None).cast("int")).alias("end_line"),
            F.lit(order).alias("_order"),
        )

    every = rows(files, "file", 0).unionByName(rows(classes, "class", 1)).unionByName(rows(functions, "function", 2))
    attributes = ["label", "type", "file", "summary", "start_line", "end_line"]
    return (
        every.groupBy(*telling_first([*keys, "id"]))
        .agg(F.max_by(F.struct(*attributes), F.struct("_order", "start_line", "end_line")).alias("n"))
        .select(*keys, "id", "n.*")
    )


def defines_edges(classes: DataFrame, functions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """File to every class and function in it."""
    def one(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col("path").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type"))

    return one(classes).unionByName(one(functions))


def name_index(classes: DataFrame, functions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(name, id): every node a name may stand for in its repository."""
    cols = [*keys, "name", "id"]
    return classes.select(*cols).unionByName(functions.select(*cols)).distinct()


def callers_and_names(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(source, name): distinct calling nodes and the name each one looks up.

    Definition names hold no dots, so a dotted callee never matches as a whole
    and always falls back to its last part; one join serves both steps.
    """
    caller = F.when(F.col("caller_function") == "__module__", F.col("path")).otherwise(
        F.concat_ws("::", "path", "caller_function")
    )
    return calls.select(*keys, caller.alias("source"), last_segment(F.col("callee"), ".").alias("name")).distinct()


def call_edges(
    calls: DataFrame,
    index: DataFrame,
    nodes: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    rows_per_chunk: int = TILE,
) -> DataFrame:
    """Caller to every candidate of the called name.

    A name called by many and defined by many is a rectangle of pairs; it is cut
    into tiles of ``rows_per_chunk`` callers by as many candidates, each a task's
    work of its own.  ``nodes`` restricts callers to known nodes;
    callers read from the same files are nodes by construction.
    """
    wanted = callers_and_names(calls, keys)
    if nodes is not None:
        wanted = wanted.join(nodes.select(*keys, F.col("id").alias("source")), [*keys, "source"], "left_semi")
    pairs = tiled_join(wanted, index, [*keys, "name"], ["source"], ["id"], rows_per_chunk, "calls")
    return pairs.select(*keys, "source", F.col("id").alias("target"), F.lit("calls").alias("type"))


def unresolved_calls(calls: DataFrame, index: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Calls whose name no definition of the repository carries."""
    return callers_and_names(calls, keys).join(index, [*keys, "name"], "left_anti")


def import_edges(
    imports: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS, resolve_relative: bool = False
) -> DataFrame:
    """Importing file to the file its module names, counted from the root.

    With ``resolve_relative`` a relative module starts at the importing file's
    directory instead.
    """
    target: Column = F.concat(F.replace(F.col("module"), F.lit("."), F.lit("/")), F.lit(".py"))
    if resolve_relative:
        folder = F.regexp_extract("path", r"^(.*/)", 1)
        target = F.when(F.col("is_relative"), F.concat(folder, target)).otherwise(target)
    wanted = imports.select(*keys, F.col("path").alias("source"), target.alias("target")).distinct()
    files = nodes.filter(F.col("type") == "file").select(*keys, F.col("id").alias("target"))
    return wanted.join(files, telling_first([*keys, "target"]), "left_semi").select(
        *keys, "source", "target", F.lit("imports").alias("type")
    )


def collapse_edges(edges: DataFrame, keys: Sequence[str] = KEYS, multi: bool = False) -> DataFrame:
    """One edge per ordered pair; the type added last stays.

    All definitions come first, then each file's calls, then its imports, so
    the last type is the highest in that order.  ``multi`` keeps every type.
    """
    if multi:
        return edges.select(*keys, "source", "target", "type").distinct()
    ranked = F.array_position(F.array(*[F.lit(t) for t in EDGE_TYPES]), F.col("type"))
    return (
        edges.groupBy(*telling_first([*keys, "source", "target"]))
        .agg(F.max_by("type", ranked).alias("type"))
        .select(*keys, "source", "target", "type")
    )


@dataclass
class CallHubs:
    """The call edges of a graph in factored form.

    A name called by many and defined by many stands for callers x candidates
    edges.  Kept as ``wanted(source, name)`` and ``index(name, id)`` it costs
    their sum, and reach, rank and entry points come out the same.  ``direct``
    holds the other edges; a definition its own file also calls is a call.
    ``staged`` says that the tables are read from storage.
    """

    direct: DataFrame
    wanted: DataFrame
    index: DataFrame
    staged: bool = False


def call_hubs(
    classes: DataFrame, functions: DataFrame, calls: DataFrame, imported: DataFrame, keys: Sequence[str] = KEYS
) -> CallHubs:
    """Factor the graph; ``imported`` are the edges of :func:`import_edges`."""
    index = name_index(classes, functions, keys)
    names = index.select(*keys, "name").distinct()
    wanted = callers_and_names(calls, keys).join(names, telling_first([*keys, "name"]), "left_semi").select(*keys, "source", "name")
    own = defines_edges(classes, functions, keys).distinct().withColumn("name", last_segment(F.col("target"), "::"))
    defined = own.join(wanted, telling_first([*keys, "source", "name"]), "left_anti").select(*keys, "source", "target", "type")
    return CallHubs(defined.unionByName(imported), wanted, index)


def entry_points(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Functions no call edge leads to; a self call counts as incoming."""
    called = edges.filter(F.col("type") == "calls").select(*keys, F.col("target").alias("id")).distinct()
    return nodes.filter(F.col("type") == "function").join(called, [*keys, "id"], "left_anti")


def with_entry_flag(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All nodes with ``is_entry_point``."""
    called = (
        edges.filter(F.col("type") == "calls")
        .select(*keys, F.col("target").alias("id"))
        .distinct()
        .withColumn("_called", F.lit(True))
    )
    return nodes.join(called, [*keys, "id"], "left").withColumn(
        "is_entry_point", (F.col("type") == "function") & F.col("_called").isNull()
    ).drop("_called")


def flag_uncalled(nodes: DataFrame, hubs: CallHubs, keys: Sequence[str] = KEYS) -> DataFrame:
    """Like :func:`with_entry_flag`, from called names instead of call edges."""
    called = hubs.wanted.select(*keys, F.col("name").alias("label")).distinct().withColumn("_called", F.lit(True))
    return nodes.join(called, telling_first([*keys, "label"]), "left").select(
        *nodes.columns, ((F.col("type") == "function") & F.col("_called").isNull()).alias("is_entry_point")
    )


def export_edges(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges as stored in a snapshot; a missing type becomes ``unknown``."""
    require(edges, [*keys, "source", "target", "type"], "export_edges")
    return edges.select(*keys, "source", "target", F.coalesce("type", F.lit("unknown")).alias("type"))
