"""Times headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the cores.  Tables
several queries share are staged first and timed as ``stage_*``; every query
is run to completion into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tributary.plans import queries as q
from tributary.session import local_session

STAGES = (
    ("stage_symbols", q.code),
    ("stage_graph", q.code_graph),
    ("stage_findings", q.code_findings),
    ("stage_trade_nodes", q.trade_nodes),
    ("stage_trade_edges", q.trade_edges),
    ("stage_trade_affected", q.trade_affected),
    ("stage_at_risk", q.trade_at_risk),
)
HEADLINE = (
    "leaks_ranked", "source_listing", "repos_within_limit", "functions", "classes", "imports", "call_sites",
    "call_edges", "import_edges", "entry_points", "todo_tags", "hardcoded_secrets", "dead_code", "import_cycles",
    "health_scores", "node_badges", "issue_nodes", "blast_radius", "witness_paths", "affected_by_entry",
    "pagerank_trade", "neighbourhood", "degrees", "call_neighbours", "directory_tree", "annotated_lines",
    "summary_prompts", "summary_responses", "repo_outline", "inline_references", "grouped_hulls", "snapshot_latest",
    "latest_job_state", "rate_limited_requests", "trailing_load",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name, build in STAGES:
        started = time.perf_counter()
        build(spark, folder)
        times[name] = round(time.perf_counter() - started, 3)
    for name in names:
        started = time.perf_counter()
        q.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
