"""Registered queries and their SQL twins.

Each query runs an operator over the whole of its tables; the twin states the
same result for another engine.  Tables derived for several queries (the parsed
corpus, its graph and findings, the trade graph) are staged once per session
and folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import (
    conversations,
    explore,
    graph,
    health,
    hull,
    impact,
    rank,
    rules,
    structure,
    summaries,
)
from tributary.plans import analysis, views
from tributary.plans import checks as sql
from tributary.schemas import MAX_FILE_BYTES, MAX_FILES_PER_REPO
from tributary.session import KEYS, shared_dir, stage
from tributary.sources import corpus, export, snapshots
from tributary.streaming import jobs, limits

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


# --- Inputs ------------------------------------------------------------------

_STAGED: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        _STAGED[key] = build()
    return _STAGED[key]


def forget_staged() -> None:
    """Drop the memory of staged tables, so the next query builds them anew."""
    _STAGED.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run SQL text over the tables it names, without shared view names."""
    used = {name: table(spark, sf, name) for name in TABLES if f" {name}" in text}
    for name in used:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **used)


def corpus_files(spark: SparkSession, sf: str) -> DataFrame:
    """One source file per document."""
    documents = corpus.spread(table(spark, sf, "documents").select("doc_id", "text"))
    return spark.sql(views.CORPUS.replace("FROM documents", "FROM {documents}"), documents=documents)


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of the repository named by their source."""
    d = corpus.spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return d.select(
        F.col("source").alias("repo"),
        F.lit("c0").alias("commit_sha"),
        F.concat(F.lit("doc/"), "doc_id").alias("path"),
        F.col("text").alias("content"),
    )


def code(spark: SparkSession, sf: str) -> analysis.Symbols:
    return _once(spark, sf, "symbols", lambda: analysis.read_symbols(corpus_files(spark, sf)))


def code_graph(spark: SparkSession, sf: str) -> analysis.Graph:
    return _once(spark, sf, "graph", lambda: analysis.build_graph(code(spark, sf)))


def code_findings(spark: SparkSession, sf: str) -> analysis.Findings:
    return _once(spark, sf, "findings", lambda: analysis.find(code(spark, sf), code_graph(spark, sf)))


def trade_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "trade-nodes", lambda: stage(view(spark, sf, views.GRAPH_NODES), "trade-nodes"))


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "trade-edges", lambda: stage(view(spark, sf, views.GRAPH_EDGES), "trade-edges"))


def trade_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One change per nation: all of its suppliers."""
    return table(spark, sf, "supplier").select(
        F.lit("supply").alias("repo"),
        F.lit("c0").alias("commit_sha"),
        F.concat(F.lit("N"), "s_nationkey").alias("seed"),
        F.concat(F.lit("S"), "s_suppkey").alias("id"),
    )


def trade_affected(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "trade-affected", lambda: impact.blast_radius(trade_edges(spark, sf), trade_changes(spark, sf))
    )


def trade_routed(spark: SparkSession, sf: str) -> DataFrame:
    """The affected nodes with the first three routes to each, for the query that lists them."""
    return _once(
        spark, sf, "trade-routed",
        lambda: impact.blast_radius(trade_edges(spark, sf), trade_changes(spark, sf), paths=True, routes=3),
    )


def code_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One change per repository: all of its classes."""
    return code_graph(spark, sf).nodes.filter("type = 'class'").select(*KEYS, F.lit("classes").alias("seed"), "id")


def code_affected(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "code-affected", lambda: impact.blast_radius(code_graph(spark, sf).edges, code_changes(spark, sf), paths=True)
    )


def trade_severity(spark: SparkSession, sf: str) -> DataFrame:
    """High issues where a supplier's balance is below zero."""
    return table(spark, sf, "supplier").select(
        F.lit("supply").alias("repo"),
        F.lit("c0").alias("commit_sha"),
        F.concat(F.lit("S"), "s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") < 0, "high").alias("issue_severity"),
    )


def trade_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        nodes, edges = trade_nodes(spark, sf), trade_edges(spark, sf)
        entries = graph.entry_points(nodes, edges)
        return impact.entry_points_at_risk(entries, edges, trade_affected(spark, sf), trade_severity(spark, sf))

    return _once(spark, sf, "at-risk", build)


def joined(name: str):
    return F.array_join(name, ",").alias(name)


# --- Sources and sinks -------------------------------------------------------

_HOST = r"[a-z.]+\.example\.(?:com|net|org)"


@query(sql.REPO_URLS)
def repo_urls(spark, sf):
    rows = corpus.parse_repo_urls(table(spark, sf, "pages").select("page_id", "url"), host=_HOST)
    return rows.select("page_id", "valid", "owner", "name")


@query(sql.REPO_PATHS)
def repo_paths(spark, sf):
    return corpus.repo_path(table(spark, sf, "pages").select("page_id", "url"), host=_HOST).select("page_id", "repo_path")


@query(sql.DECODED)
def decoded_sources(spark, sf):
    """Files as bytes: some end in a byte that is no text, some cannot be read."""
    n, body = F.col("doc_id"), F.col("text").cast("binary")
    held = F.when(n % 10 == 3, F.concat(body, F.lit(b"\xff"))).when(n % 10 == 4, F.lit(None)).otherwise(body)
    tree = table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.lit("c0").alias("commit_sha"), F.concat(F.lit("doc/"), n).alias("path"), held.alias("bytes")
    )
    return corpus.load_contents(tree).select(*KEYS, "path", "content")


@query(sql.STORED_DOCUMENTS)
def stored_documents(spark, sf):
    """Stored JSON documents, one for each document of the tables: whole ones, empty ones, broken ones, and ones that lack a part."""
    n = F.col("doc_id")
    node = F.struct(F.concat(F.lit("n"), n).alias("id"), F.col("lang").alias("label"), F.lit("file").alias("type"), F.col("source").alias("file"), F.col("text").alias("summary"))
    edge = F.struct(F.concat(F.lit("n"), n).alias("source"), F.concat(F.lit("n"), n + 1).alias("target"), F.lit("calls").alias("type"))
    whole = [F.col("source").alias("repo"), F.lit("c0").alias("commit_sha")]
    nodes, edges = F.array(node, node).alias("nodes"), F.array(edge).alias("edges")
    value = (
        F.when(n % 7 == 1, "").when(n % 7 == 2, F.concat(F.lit('{"repo": "'), F.substring("text", 1, 9)))
        .when(n % 7 == 3, F.to_json(F.struct(*whole, edges))).when(n % 7 == 4, F.to_json(F.struct(*whole, nodes)))
        .otherwise(F.to_json(F.struct(*whole, nodes, edges)))
    )
    raw = table(spark, sf, "documents").select(F.concat(F.lit("f"), n, F.lit(".json")).alias("file"), value.alias("value"))
    found = snapshots.checked_documents(raw)
    summaries = F.sum(F.length(F.col("summary"))).cast("long").alias("summary_chars")
    per_file = snapshots.document_nodes(found).groupBy("repo").agg(F.count("*").alias("nodes"), F.count_distinct("id").alias("ids"), summaries)
    calls = snapshots.document_edges(found).groupBy("repo").agg(F.count("*").alias("edges"))
    rejects = found.filter("not valid").agg(F.count("*").alias("rejects"))
    return per_file.join(calls, "repo").select("repo", "nodes", "ids", "summary_chars", "edges").unionByName(
        rejects.select(F.lit("rejects").alias("repo"), F.col("rejects").alias("nodes"), *(F.lit(None).cast("long").alias(c) for c in ("ids", "summary_chars", "edges")))
    )


@query(sql.LISTING)
def source_listing(spark, sf):
    return corpus.list_sources(corpus_files(spark, sf), max_bytes=MAX_FILE_BYTES).select(*KEYS, "path", "size")


@query(sql.LISTING_SEGMENT)
def source_listing_by_segment(spark, sf):
    return corpus.list_sources(corpus_files(spark, sf), match="segment", max_bytes=MAX_FILE_BYTES).select(*KEYS, "path", "size")


@query(sql.WITHIN_LIMIT)
def repos_within_limit(spark, sf):
    files = corpus.list_sources(corpus_files(spark, sf), max_bytes=MAX_FILE_BYTES).select(*KEYS, "path", "size")
    return corpus.within_limit(files, MAX_FILES_PER_REPO)


@query(sql.OVER_LIMIT)
def repos_over_limit(spark, sf):
    return corpus.over_limit(corpus.list_sources(corpus_files(spark, sf), max_bytes=MAX_FILE_BYTES), MAX_FILES_PER_REPO)


@query(sql.FILE_SOURCES)
def file_sources(spark, sf):
    s = code(spark, sf)
    wanted = s.imports.select(*KEYS, F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py")).alias("path"))
    rows = corpus.file_sources(s.files, wanted)
    return rows.select(*KEYS, "path", "found", F.md5("content").alias("digest"))


@query(sql.SNAPSHOT_KEYS)
def snapshot_keys(spark, sf):
    from tributary.functions.text import snapshot_key

    d = table(spark, sf, "documents")
    sha = F.concat(F.lit("Sha@"), "doc_id")
    repo = F.concat(F.lit("My.Org/"), "source", F.lit("+"), "lang", F.lit("!"))
    return d.select("doc_id", snapshot_key(repo, sha).alias("snapshot_key"))


def document_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as stored snapshots: one per source and language."""
    d = table(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("repo"), F.col("lang").alias("commit_sha")).agg(
        F.timestamp_seconds(F.max("doc_id") * 60).alias("cached_at"), F.sum("n_chars").alias("bytes")
    )


@query(sql.SNAPSHOT_LISTING)
def snapshot_listing(spark, sf):
    rows = snapshots.listing(document_catalog(spark, sf))
    return rows.withColumn("cached_at", F.unix_seconds("cached_at"))


@query(sql.SNAPSHOT_STATS)
def snapshot_stats(spark, sf):
    rows = snapshots.stats(document_catalog(spark, sf))
    return rows.withColumns({c: F.unix_seconds(c) for c in ("oldest_entry", "newest_entry")})


@query(sql.SNAPSHOT_LATEST)
def snapshot_latest(spark, sf):
    entries = table(spark, sf, "orders").select(
        F.concat(F.lit("Cust/"), "o_custkey").alias("repo"),
        F.col("o_orderkey").alias("commit_sha"),
        F.col("o_orderdate").alias("cached_at"),
        "o_totalprice",
    )
    return snapshots.latest(entries).select("repo", "commit_sha", "o_totalprice")


@query(sql.SNAPSHOT_ROUND_TRIP)
def snapshot_round_trip(spark, sf):
    def build():
        store = snapshots.SnapshotStore(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
        for _ in range(2):  # the second write replaces the first
            store.write(
                trade_nodes(spark, sf).withColumns(
                    {"summary": F.lit(""), "start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int")}
                ),
                trade_edges(spark, sf),
            )
        return store

    store = _once(spark, sf, "store", build)
    nodes, edges = store.read("Supply", "c0")
    rows = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
    more = edges.groupBy("type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("ids")
    )
    return rows.unionByName(more)


@query(sql.GRAPH_META)
def graph_meta(spark, sf):
    edges = trade_edges(spark, sf)
    return snapshots.graph_meta(graph.with_entry_flag(trade_nodes(spark, sf), edges), edges)


@query(sql.CONVERSATION_BLOCKS)
def conversation_blocks(spark, sf):
    return export.conversation_blocks(table(spark, sf, "conversations"))


# --- Symbols -----------------------------------------------------------------


@query(sql.DOCUMENT_LINES)
def document_lines(spark, sf):
    return rules.lines(document_files(spark, sf)).select(*KEYS, "path", "line", "text")


@query(sql.FUNCTIONS)
def functions(spark, sf):
    rows = code(spark, sf).functions
    return rows.select(
        *KEYS, "path", "id", "name", "start_line", "end_line", joined("parameters"), "is_method",
        joined("decorator_names"), "docstring",
    )


@query(sql.CLASSES)
def classes(spark, sf):
    rows = code(spark, sf).classes
    return rows.select(
        *KEYS, "path", "id", "name", "start_line", "end_line", joined("base_classes"), joined("method_names"),
        joined("class_variables"), "docstring",
    )


@query(sql.IMPORTS)
def imports(spark, sf):
    rows = code(spark, sf).imports
    return rows.select(*KEYS, "path", "line", "module", joined("names"), "is_relative")


@query(sql.CALLS)
def call_sites(spark, sf):
    return code(spark, sf).calls.select(*KEYS, "path", "line", "caller_function", "callee")


@query(sql.PARSED_FILES)
def parsed_files(spark, sf):
    """Files of a run with isolation: null and blank files stay, empty."""
    def count(kind: str):
        return F.coalesce(F.size(F.filter("statements", lambda s: s["kind"] == kind)), F.lit(0)).alias(f"{kind}s")

    return code(spark, sf).parsed.select(*KEYS, "path", count("def"), count("decorator"))


# --- Graph -------------------------------------------------------------------


@query(sql.NODES)
def graph_nodes(spark, sf):
    return code_graph(spark, sf).nodes.select(*KEYS, "id", "label", "type", "file", "start_line", "end_line", "is_entry_point")


@query(sql.DEFINES)
def defines_edges(spark, sf):
    s = code(spark, sf)
    return graph.defines_edges(s.classes, s.functions).distinct()


@query(sql.NAME_INDEX)
def name_index(spark, sf):
    s = code(spark, sf)
    return graph.name_index(s.classes, s.functions)


@query(sql.CALL_EDGES)
def call_edges(spark, sf):
    s = code(spark, sf)
    return graph.call_edges(s.calls, graph.name_index(s.classes, s.functions), code_graph(spark, sf).nodes)


@query(sql.UNRESOLVED)
def unresolved_calls(spark, sf):
    s = code(spark, sf)
    return graph.unresolved_calls(s.calls, graph.name_index(s.classes, s.functions))


@query(sql.IMPORT_EDGES)
def import_edges(spark, sf):
    return graph.import_edges(code(spark, sf).imports, code_graph(spark, sf).nodes)


@query(sql.EDGES)
def graph_edges(spark, sf):
    return graph.export_edges(code_graph(spark, sf).edges)


@query(sql.MULTI_EDGES)
def graph_edges_multi(spark, sf):
    s = code(spark, sf)
    every = (
        graph.defines_edges(s.classes, s.functions)
        .unionByName(graph.call_edges(s.calls, graph.name_index(s.classes, s.functions)))
        .unionByName(graph.import_edges(s.imports, code_graph(spark, sf).nodes))
    )
    return graph.collapse_edges(every, multi=True)


@query(sql.ENTRY_POINTS)
def entry_points(spark, sf):
    g = code_graph(spark, sf)
    return graph.entry_points(g.nodes, g.edges).select(*KEYS, "id")


@query(sql.TRADE_ENTRIES)
def trade_entry_points(spark, sf):
    return graph.entry_points(trade_nodes(spark, sf), trade_edges(spark, sf)).select(*KEYS, "id")


@query(sql.PAGERANK_TRADE)
def pagerank_trade(spark, sf):
    return rank.pagerank(trade_nodes(spark, sf), trade_edges(spark, sf), iterations=sql.ROUNDS, digits=9)


@query(sql.PAGERANK_CODE)
def pagerank_code(spark, sf):
    g = code_graph(spark, sf)
    return rank.pagerank(g.nodes, g.edges, iterations=sql.ROUNDS, digits=9)


@query(sql.PAGERANK_CODE)
def pagerank_by_names(spark, sf):
    """The same ranks without writing call edges out."""
    g = code_graph(spark, sf)
    return rank.pagerank(g.nodes, g.hubs.direct, iterations=sql.ROUNDS, digits=9, hubs=g.hubs)


# --- Line rules --------------------------------------------------------------


def _found(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "file", "line", "severity", "type", "message")


@query(sql.DOCUMENT_SECRETS)
def document_secrets(spark, sf):
    return _found(rules.scan(rules.lines(document_files(spark, sf)), [rules.secret_finding]))


@query(sql.LEAKS_RANKED)
def leaks_ranked(spark, sf):
    """Which documents leak credentials, and which are worst?"""
    issues = structure.unique_issues(rules.scan(rules.lines(document_files(spark, sf)), [rules.secret_finding]))
    return health.ranked_files(health.file_issues(issues))


@query(sql.TEST_FILES)
def test_files(spark, sf):
    from tributary.functions.text import is_test_path

    files = corpus_files(spark, sf)
    return files.select(*KEYS, "path", is_test_path(F.col("path")).alias("is_test"))


@query(sql.COMMENTS)
def comment_lines(spark, sf):
    from tributary.functions.text import is_comment

    lines = rules.lines(code(spark, sf).files)
    return lines.groupBy(*KEYS, "path").agg(F.count_if(is_comment(F.col("text"))).alias("comments"), F.count(F.lit(1)).alias("lines"))


def _rule(name: str, rule, oracle: str) -> None:
    @query(oracle, name)
    def run(spark, sf):
        return _found(rules.scan(rules.lines(code(spark, sf).files), [rule]))


_rule("hardcoded_secrets", rules.secret_finding, sql.SECRETS)
_rule("sql_injections", rules.sql_injection_finding, sql.INJECTIONS)
_rule("eval_uses", rules.eval_finding, sql.EVALS)
_rule("debug_leftovers", rules.debug_finding, sql.DEBUGS)
_rule("todo_tags", rules.todo_finding, sql.TODOS)


# --- Structure ---------------------------------------------------------------


@query(sql.LONG)
def long_functions(spark, sf):
    return _found(structure.long_functions(code_graph(spark, sf).nodes))


@query(sql.MANY_PARAMETERS)
def many_parameters(spark, sf):
    return _found(structure.many_parameters(code(spark, sf).functions, limit=5))


@query(sql.MISSING_DOCS)
def missing_docstrings(spark, sf):
    return _found(structure.missing_docstrings(code(spark, sf).functions))


@query(sql.GOD_OBJECTS)
def god_objects(spark, sf):
    return _found(structure.god_objects(code(spark, sf).classes))


@query(sql.CYCLES)
def import_cycles(spark, sf):
    return _found(structure.import_cycles(code_graph(spark, sf).edges))


@query(sql.DEAD)
def dead_code(spark, sf):
    g = code_graph(spark, sf)
    return _found(structure.dead_code(g.nodes, g.edges))


def _pattern(name: str, run: Callable[[analysis.Symbols], DataFrame], oracle: str) -> None:
    @query(oracle, name)
    def fn(spark, sf):
        return run(code(spark, sf)).select(*KEYS, "name", "file", "class", "description")


_pattern("singletons", lambda s: structure.singletons(s.classes), sql.SINGLETONS)
_pattern("factory_classes", lambda s: structure.factory_classes(s.classes), sql.FACTORY_CLASSES)
_pattern("repository_classes", lambda s: structure.repositories(s.classes), sql.REPOSITORIES)
_pattern("context_managers", lambda s: structure.context_managers(s.classes), sql.CONTEXT_MANAGERS)
_pattern("factory_functions", lambda s: structure.factory_functions(s.functions), sql.FACTORY_FUNCTIONS)
_pattern("decorator_functions", lambda s: structure.decorator_functions(s.functions), sql.DECORATORS)


@query(sql.UNIQUE_PATTERNS)
def unique_patterns(spark, sf):
    return code_findings(spark, sf).patterns.select(*KEYS, "name", "file", "class", "description")


@query(sql.UNIQUE_ISSUES)
def unique_issues(spark, sf):
    return code_findings(spark, sf).issues.select(*KEYS, "id", "file", "line", "severity", "type", "message", "function")


# --- Health ------------------------------------------------------------------


@query(sql.FILE_ISSUES)
def file_issues(spark, sf):
    return health.file_issues(code_findings(spark, sf).issues)


@query(sql.BADGES)
def node_badges(spark, sf):
    nodes = health.badge_nodes(code_graph(spark, sf).nodes, health.file_issues(code_findings(spark, sf).issues))
    return nodes.select(*KEYS, "id", "issue_count", "issue_severity")


@query(sql.HEALTH)
def health_scores(spark, sf):
    found = code_findings(spark, sf)
    return health.health(code_graph(spark, sf).nodes, found.issues, found.patterns)


@query(sql.GRADES)
def grades(spark, sf):
    d = table(spark, sf, "documents")
    score = F.pmod(F.col("n_chars"), F.lit(101))
    return d.select("doc_id", score.alias("score"), health.grade(score).alias("grade"))


@query(sql.METRICS)
def node_metrics(spark, sf):
    m = health.node_metrics(code_graph(spark, sf).nodes)
    return m.withColumn("coverage", health.coverage(m))


@query(sql.COMPLEX)
def most_complex_files(spark, sf):
    return health.most_complex_file(code_graph(spark, sf).nodes)


@query(sql.SEVERITY_TOTALS)
def severity_totals(spark, sf):
    return health.severity_totals(code_findings(spark, sf).issues)


@query(sql.RANKED_FILES)
def ranked_files(spark, sf):
    return health.ranked_files(health.file_issues(code_findings(spark, sf).issues))


@query(sql.FILTERED_ISSUES)
def medium_issues_in_files(spark, sf):
    issues = code_findings(spark, sf).issues
    return health.issues_in_files(issues, health.file_issues(issues), "medium").select(
        *KEYS, "file", "file_severity", "line", "message"
    )


@query(sql.ISSUE_NODES)
def issue_nodes(spark, sf):
    return health.issue_nodes(code_findings(spark, sf).issues, code_graph(spark, sf).nodes)


# --- Impact ------------------------------------------------------------------


@query(sql.REVERSE)
def reverse_dependencies(spark, sf):
    return impact.reverse_dependencies(trade_edges(spark, sf))


@query(sql.BLAST)
def blast_radius(spark, sf):
    return trade_affected(spark, sf).select(*KEYS, "seed", "id", "depth", "severity")


@query(sql.BLAST_CODE)
def blast_radius_code(spark, sf):
    return code_affected(spark, sf).select(*KEYS, "seed", "id", "depth", "severity")


@query(sql.BLAST_CODE)
def blast_radius_by_names(spark, sf):
    """The same reach without writing call edges out."""
    hubs = code_graph(spark, sf).hubs
    found = impact.blast_radius(hubs.direct, code_changes(spark, sf), hubs=hubs)
    return found.select(*KEYS, "seed", "id", "depth", "severity")


@query(sql.PATHS)
def witness_paths(spark, sf):
    found = impact.witness_paths(trade_edges(spark, sf), trade_routed(spark, sf))
    return found.select(*KEYS, "seed", "id", "rank", F.array_join("path", ">").alias("path"))


@query(sql.IMPACT_TOTALS)
def impact_totals(spark, sf):
    return impact.impact_totals(trade_affected(spark, sf))


@query(sql.IMPACT_DEPTHS)
def impact_by_depth(spark, sf):
    return impact.impact_by_depth(trade_affected(spark, sf))


@query(sql.IMPACT_SEVERITIES)
def impact_by_severity(spark, sf):
    return impact.impact_by_severity(trade_affected(spark, sf))


@query(sql.AT_RISK)
def entry_points_at_risk(spark, sf):
    return trade_at_risk(spark, sf)


@query(sql.AFFECTED_BY_ENTRY)
def affected_by_entry(spark, sf):
    nodes, edges = trade_nodes(spark, sf), trade_edges(spark, sf)
    return impact.affected_by_entry(graph.entry_points(nodes, edges), edges, trade_affected(spark, sf))


@query(sql.NEIGHBOURHOOD)
def neighbourhood(spark, sf):
    rows = impact.neighbourhood(trade_nodes(spark, sf), trade_edges(spark, sf))
    return rows.select(*KEYS, "id", joined("callers"), joined("callees"), joined("importers"))


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier as a proposed change of its nation's group."""
    return trade_changes(spark, sf).withColumn("change", F.concat(F.lit("Replace "), "id"))


@query(sql.PROMPT_PARTS_EACH)
def impact_prompt_parts_by_supplier(spark, sf):
    """A prompt for every supplier, each a change of its own."""
    nodes, edges = trade_nodes(spark, sf).withColumn("summary", F.lit("")), trade_edges(spark, sf)
    proposed = _proposed(spark, sf).withColumn("seed", F.col("id"))
    affected = impact.blast_radius(edges, proposed.select(*KEYS, "seed", "id"))
    entries = graph.entry_points(nodes, edges)
    at_risk = impact.entry_points_at_risk(entries, edges, affected, trade_severity(spark, sf))
    return impact.impact_prompt_parts(proposed, nodes, impact.neighbourhood(nodes, edges, of=proposed), affected, at_risk)


@query(sql.PAYLOAD)
def impact_payload(spark, sf):
    return impact.impact_payload(trade_affected(spark, sf), trade_at_risk(spark, sf))


@query(sql.RISK_LEVELS)
def risk_levels(spark, sf):
    d = table(spark, sf, "documents")
    label = F.element_at(
        F.array(*[F.lit(x) for x in ("Risk_level: safe", "RISK_LEVEL:RISKY", "risk_level:  dangerous.", "no verdict")]),
        (F.pmod("doc_id", F.lit(4)) + 1).cast("int"),
    )
    rows = d.select("doc_id", F.concat("text", F.lit("\n"), label).alias("response"))
    return impact.risk_level(rows).select("doc_id", "risk_level")


@query(sql.CASCADE)
def impact_cascade(spark, sf):
    return impact.cascade(trade_affected(spark, sf), trade_nodes(spark, sf))


@query(sql.EDGE_IMPACT)
def edge_impact(spark, sf):
    return impact.edge_impact(code_graph(spark, sf).edges, code_affected(spark, sf))


# --- Summaries ---------------------------------------------------------------


@query(sql.SYMBOLS_BY_FILE)
def symbols_by_file(spark, sf):
    return summaries.symbols_by_file(code_graph(spark, sf).nodes)


@query(sql.FIRST_ITEMS)
def first_items(spark, sf):
    rows = summaries.first_items(summaries.symbols_by_file(code_graph(spark, sf).nodes), limit=10)
    return rows.select(*KEYS, "file", "rank", "id")


@query(sql.PROMPTS)
def summary_prompts(spark, sf):
    rows = summaries.prompts(summaries.first_items(summaries.symbols_by_file(code_graph(spark, sf).nodes)))
    return rows.select(*KEYS, "file", "items", F.md5("prompt").alias("digest"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers made from whole documents, some of them unreadable."""
    text = sql.ANSWERS.replace("$BODY", "trim(regexp_replace(text, '[^a-zA-Z]+', ' '))")
    text = text.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}")
    return spark.sql(text, documents=corpus.spread(table(spark, sf, "documents")))


@query(sql.RESPONSES)
def summary_responses(spark, sf):
    return summaries.parse_responses(_answers(spark, sf), ("doc_id",))


@query(sql.FALLBACK)
def summary_fallback(spark, sf):
    answers = _answers(spark, sf)
    primary = answers.filter(F.col("lang") != "en")
    second = answers.filter(F.col("lang").isin("en", "de")).withColumn("response", F.concat(F.lit("second "), "lang"))
    rows = summaries.with_fallback(answers, primary, second, ("doc_id",))
    return rows.select("doc_id", F.md5("response").alias("digest"))


@query(sql.MERGED_ALL)
def merged_summaries_of_all(spark, sf):
    nodes = code_graph(spark, sf).nodes
    made = nodes.filter("type = 'function'").select(
        *KEYS, "file", F.col("label").alias("name"), F.concat(F.lit("Runs "), "label").alias("summary")
    )
    return summaries.merge_summaries(nodes, made).select(*KEYS, "id", "summary")


# --- Conversations -----------------------------------------------------------


@query(sql.OUTLINE)
def repo_outline(spark, sf):
    return conversations.outline_lines(code_graph(spark, sf).nodes)


@query(sql.OUTLINE_TEXT)
def repo_outline_text(spark, sf):
    rows = conversations.outline_text(conversations.outline_lines(code_graph(spark, sf).nodes))
    return rows.select(*KEYS, "file", F.md5("text").alias("digest"))


@query(sql.ENTRY_CONTEXT)
def entry_context(spark, sf):
    return conversations.entry_context(code_graph(spark, sf).nodes)


@query(sql.CALL_CONTEXT)
def call_context(spark, sf):
    return conversations.call_context(code_graph(spark, sf).edges)


@query(sql.LAST_MESSAGES)
def last_messages(spark, sf):
    return conversations.last_messages(table(spark, sf, "conversations")).select("conv_id", "turn", "rank", "role", "text")


@query(sql.SUGGESTIONS)
def suggested_questions(spark, sf):
    return conversations.suggestions(code_graph(spark, sf).nodes)


def _chat(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(
        text.replace("FROM documents", "FROM {documents}"), documents=corpus.spread(table(spark, sf, "documents").select("doc_id", "text"))
    )


@query(sql.ANSWER_REFERENCES)
def answer_references(spark, sf):
    return conversations.answer_references(_chat(spark, sf, sql.CHAT_ANSWERS), code_graph(spark, sf).nodes, ["doc_id"]).select(
        *KEYS, "doc_id", "id"
    )


@query(sql.INLINE_REFERENCES)
def inline_references(spark, sf):
    return conversations.inline_references(
        _chat(spark, sf, sql.CHAT_ANSWERS), code_graph(spark, sf).nodes, ["doc_id"]
    ).select(*KEYS, "doc_id", "ordinal", "id")


@query(sql.IMPACT_REFERENCES)
def impact_references(spark, sf):
    return conversations.inline_references(
        _chat(spark, sf, sql.CHAT_ANSWERS), code_graph(spark, sf).nodes, ["doc_id"], by_label=True
    ).select(*KEYS, "doc_id", "token", "id")


# --- Exploration -------------------------------------------------------------


@query(sql.SEARCH)
def search_nodes(spark, sf):
    return explore.search_nodes(trade_nodes(spark, sf), "r1/n1")


@query(sql.CALL_NEIGHBOURS)
def call_neighbours(spark, sf):
    return explore.call_neighbours(trade_nodes(spark, sf), trade_edges(spark, sf))


@query(sql.DEGREES)
def degrees(spark, sf):
    return explore.degrees(trade_nodes(spark, sf), trade_edges(spark, sf))


@query(sql.DIRECTORIES)
def directory_groups(spark, sf):
    return explore.directory_groups(code_graph(spark, sf).nodes)


@query(sql.FIRST_DIRECTORIES)
def first_directories(spark, sf):
    return explore.first_directories(explore.directory_groups(code_graph(spark, sf).nodes), limit=3)


@query(sql.TREE)
def directory_tree(spark, sf):
    return explore.listing_order(explore.directory_tree(code_graph(spark, sf).nodes))


@query(sql.TREE_SEARCH)
def search_tree(spark, sf):
    return explore.search_tree(explore.directory_tree(code_graph(spark, sf).nodes), "SUB1/M")


@query(sql.FILE_SYMBOLS)
def file_symbols(spark, sf):
    return explore.file_symbols(code_graph(spark, sf).nodes)


@query(sql.TYPE_TOTALS)
def type_totals(spark, sf):
    return explore.type_totals(trade_nodes(spark, sf))


@query(sql.FILE_TOTALS)
def file_totals(spark, sf):
    return explore.file_totals(code(spark, sf).files, code_graph(spark, sf).nodes)


@query(sql.CALLS_BY_LINE)
def calls_by_definition(spark, sf):
    g = code_graph(spark, sf)
    return explore.calls_by_definition(g.nodes, g.edges)


@query(sql.ANNOTATED)
def annotated_lines(spark, sf):
    g = code_graph(spark, sf)
    chosen = g.nodes.filter("type = 'class'").select(*KEYS, "id")
    return explore.annotate_lines(rules.lines(code(spark, sf).files), g.nodes, chosen)


@query(sql.FILE_EDGES)
def file_edges(spark, sf):
    g = code_graph(spark, sf)
    return explore.file_edges(g.nodes, g.edges, suffix=".py")


@query(sql.WEIGHTS)
def node_weights(spark, sf):
    nodes, edges = trade_nodes(spark, sf), trade_edges(spark, sf)
    ranked = graph.with_entry_flag(nodes, edges).join(explore.degrees(nodes, edges), [*KEYS, "id"])
    return explore.node_weights(ranked.withColumn("centrality", F.col("in_degree") / 1000.0)).withColumn(
        "weight", F.round("weight", 6)
    )


@query(sql.SCALED_WEIGHTS)
def node_weights_scaled(spark, sf):
    nodes = code_graph(spark, sf).nodes.withColumn("centrality", F.coalesce(F.col("start_line"), F.lit(0)) / 1000.0)
    return explore.node_weights(nodes, code_affected(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(sql.INCIDENT)
def incident_edges(spark, sf):
    g = code_graph(spark, sf)
    return explore.incident_edges(g.edges, g.nodes.filter("type = 'class'"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.spread(table(spark, sf, "lineitem")).select(
        "l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )


@query(sql.HULLS)
def grouped_hulls(spark, sf):
    return hull.hulls(_points(spark, sf), ["l_returnflag"]).select("l_returnflag", "x", "y")


@query(sql.EXPANDED)
def expanded_hulls(spark, sf):
    rows = hull.expand(hull.hulls(_points(spark, sf), ["l_returnflag"]), ["l_returnflag"])
    return rows.select("l_returnflag", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# --- Events ------------------------------------------------------------------


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as progress reports of the job named by their user."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "done").when(kind == "error", "error").when(kind == "signup", "queued").otherwise("running").alias("status"),
        F.pmod("event_id", F.lit(100)).cast("int").alias("progress"),
        kind.alias("stage"),
        F.col("props").alias("message"),
        F.when(kind == "error", F.col("props")).alias("error"),
        F.concat(F.pmod("user_id", F.lit(20)), F.lit(" , 10.0.0.1")).alias("forwarded"),
        F.lit("peer").alias("peer"),
    )


@query(sql.LATEST_STATE)
def latest_job_state(spark, sf):
    rows = jobs.latest_state(job_events(spark, sf), tie=["event_id"])
    return rows.withColumn("ts", F.unix_micros("ts"))


@query(sql.UNEXPIRED)
def unexpired_jobs(spark, sf):
    e = job_events(spark, sf).withColumn("job_id", F.concat_ws("-", "job_id", F.to_date("ts").cast("string")))
    rows = jobs.unexpired(e, "2024-01-20 12:00:00", ttl="240 hours")
    return rows.withColumn("created_at", F.unix_micros("created_at"))


@query(sql.RATE_LIMITED)
def rate_limited_requests(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return limits.rate_limited(e, "event_type", limit=2).select("event_id", "event_type", "accepted")


@query(sql.RATE_LIMITED_USERS)
def rate_limited_impact_requests(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.concat_ws("_", F.lit("impact"), "user_id").alias("client"))
    return limits.rate_limited(e, "client", limit=1, window=6 * limits.HOUR).select("event_id", "client", "accepted")


@query(sql.RATE_LIMITED_CLIENTS)
def rate_limited_chat_requests(spark, sf):
    """By client and day: a busy client's requests depend on each other."""
    e = table(spark, sf, "events").select("event_id", "ts", F.concat_ws("_", F.lit("chat"), "user_id").alias("client"))
    return limits.rate_limited(e, "client", limit=2, window=24 * limits.HOUR, rows_per_scan=4096).select("event_id", "client", "accepted")


@query(sql.TRAILING)
def trailing_load(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return limits.trailing_load(e, ["event_type"]).select("event_id", "event_type", "load")


@query(sql.ACTIVE)
def active_jobs_by_client(spark, sf):
    return jobs.active_by_client(job_events(spark, sf), tie=["event_id"])


@query(sql.ACTIVE_TOTAL)
def active_jobs_total(spark, sf):
    return jobs.active_total(jobs.latest_state(job_events(spark, sf), tie=["event_id"]))


@query(sql.REMAINING)
def remaining_time(spark, sf):
    states = jobs.latest_state(job_events(spark, sf), tie=["event_id"])
    timed = states.withColumn("elapsed", F.pmod("job_id", F.lit(90)))
    return jobs.with_remaining(timed).select("job_id", "status", "progress", "remaining")
