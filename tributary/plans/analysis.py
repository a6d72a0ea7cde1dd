"""The analysis of a corpus: from files to graph, findings and health."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import graph, health, rank, rules, structure, symbols
from tributary.session import KEYS, KeyedChunks, stage


@dataclass
class Symbols:
    """Symbol tables of a corpus, read from one staged parse."""

    files: DataFrame
    parsed: DataFrame
    functions: DataFrame
    classes: DataFrame
    imports: DataFrame
    calls: DataFrame


@dataclass
class Graph:
    """Flagged nodes, and calls in factored form.

    ``edges`` writes the graph out edge by edge, one per caller and candidate;
    findings, rank and reach do not need it.
    """

    nodes: DataFrame
    hubs: graph.CallHubs

    @cached_property
    def edges(self) -> DataFrame:
        chunks = KeyedChunks(self.hubs.wanted, [*KEYS, "name"], ["source"], label="calls", staged=self.hubs.staged)
        calls = chunks.probe(self.hubs.index).select(*KEYS, "source", F.col("id").alias("target"), F.lit("calls").alias("type"))
        return stage(graph.collapse_edges(self.hubs.direct.unionByName(calls)), "edges")


@dataclass
class Findings:
    issues: DataFrame
    patterns: DataFrame


def read_symbols(files: DataFrame) -> Symbols:
    """Parse once, stage the statements, derive the four symbol tables."""
    parsed = stage(symbols.parse_files(files), "statements")
    return Symbols(
        files,
        parsed,
        symbols.functions(parsed),
        symbols.classes(parsed),
        symbols.imports(parsed),
        symbols.call_sites(parsed),
    )


def build_graph(s: Symbols) -> Graph:
    """Nodes and factored edges, staged for the many queries over them."""
    nodes = stage(graph.nodes(s.parsed, s.classes, s.functions), "nodes")
    hubs = graph.call_hubs(s.classes, s.functions, s.calls, graph.import_edges(s.imports, nodes))
    hubs = graph.CallHubs(stage(hubs.direct, "direct"), stage(hubs.wanted, "wanted"), stage(hubs.index, "index"), staged=True)
    return Graph(stage(graph.flag_uncalled(nodes, hubs), "nodes-flagged"), hubs)


def all_issues(s: Symbols, g: Graph) -> DataFrame:
    """Issue rows of every rule, before duplicates are dropped."""
    parts = [
        rules.scan(rules.lines(s.files)),
        structure.long_functions(g.nodes),
        structure.many_parameters(s.functions),
        structure.missing_docstrings(s.functions),
        structure.god_objects(s.classes),
        structure.import_cycles(g.hubs.direct),
        structure.dead_flagged(g.nodes),
    ]
    return reduce(DataFrame.unionByName, parts)


def all_patterns(s: Symbols) -> DataFrame:
    return structure.class_patterns(s.classes).unionByName(structure.function_patterns(s.functions))


def find(s: Symbols, g: Graph) -> Findings:
    return Findings(
        stage(structure.unique_issues(all_issues(s, g)), "issues"),
        stage(structure.unique_patterns(all_patterns(s)), "patterns"),
    )


def analyse(files: DataFrame, ranked: bool = True) -> tuple[Graph, Findings, DataFrame]:
    """Graph with centrality and badges, findings, and one health row per repository."""
    s = read_symbols(files)
    g = build_graph(s)
    found = find(s, g)
    nodes = health.badge_nodes(g.nodes, health.file_issues(found.issues))
    if ranked:
        centrality = rank.pagerank(g.nodes, g.hubs.direct, hubs=g.hubs)
        nodes = nodes.join(centrality, ["repo", "commit_sha", "id"])
    return Graph(nodes, g.hubs), found, health.health(g.nodes, found.issues, found.patterns)


def only_new(files: DataFrame, missing: DataFrame) -> DataFrame:
    """Files of snapshots not stored yet, for incremental runs."""
    return files.join(missing, ["repo", "commit_sha"], "left_semi")
