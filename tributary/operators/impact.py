"""What a change reaches: blast radius, entry points at risk, impact prompts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import blast_severity
from tributary.operators.graph import CallHubs
from tributary.schemas import BLAST_SEVERITIES, DEFAULT_RISK, EDGE_TYPES, RISK_LEVELS
from tributary.session import KEYS, ROWS_PER_CHUNK, Collected, KeyedChunks, StagedRounds, first_k, stage, telling_first, unstage


#: Lots of seed groups in a walk over many edges that keeps routes: its rows are long.
ROUTE_TURNS = 3


def reverse_dependencies(
    edges: DataFrame, types: Sequence[str] = EDGE_TYPES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``(id, dependent)``: who is affected when ``id`` changes."""
    return _reversed(edges, types, keys).distinct()


def _reversed(edges: DataFrame, types: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Reverse dependencies for walks, which group what arrives: a pair that two types join may come twice."""
    return edges.filter(F.col("type").isin(*types)).select(*keys, F.col("target").alias("id"), F.col("source").alias("dependent"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _settled(result: DataFrame, rounds: list[DataFrame], label: str) -> DataFrame:
    """The result as one staged table; the rounds it was made from are deleted."""
    out = stage(result, label)
    for part in rounds:
        unstage(part)
    return out


@dataclass
class Steps:
    """One step of a walk: plain edges, and callers behind called names.

    ``names`` leads from a node to the names it may be called by, ``callers``
    from a name to its callers.  Each name is passed once per seed, so a name
    with many definitions and many callers costs their sum.
    """

    plain: KeyedChunks
    to: str
    names: KeyedChunks | None = None
    callers: KeyedChunks | None = None

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        for table in (self.plain, self.names, self.callers):
            if table is not None:
                table.__exit__()


def reach(
    seeds: DataFrame,
    steps: Steps,
    keys: Sequence[str] = KEYS,
    max_depth: int | None = None,
    paths: bool = False,
    label: str = "reach",
    routes: int = 0,
    turns: int = 1,
) -> DataFrame:
    """Breadth-first reach of every seed group at once: ``(seed, id, depth)``.

    One round joins the frontier to the steps, keeps one row per new
    ``(seed, id)`` and stages it; the loop ends with an empty frontier, and the
    rounds are the parts of one table.  With
    ``paths`` each row carries its first path: the smallest one, by ids, among
    the shortest.  With ``routes`` it carries ``rank`` and ``path`` instead: up to so
    many rows per ``(seed, id)``, by the round they arrive in, then by path; the first of them
    is the node's first path.  Names of ``steps`` pass one path each, so routes take plain steps only.
    Seed groups know nothing of each other; with ``turns`` they walk in so many lots, one after the
    other, and the disk between rounds holds one lot.
    """
    keys = list(keys)
    if routes and steps.names is not None:
        raise ValueError("routes need plain steps")
    start = seeds.select(*keys, "seed", "id").distinct().withColumn("depth", F.lit(0))
    if routes:
        # a row holds its predecessor's path; its own ends with its id
        start = start.withColumns({"rank": F.lit(1), "via": F.expr("CAST(array() AS array<string>)")})
    elif paths:
        start = start.withColumn("path", F.array("id"))
    seen = StagedRounds(seeds.sparkSession, label)
    between = []
    node, name = telling_first([*keys, "seed", "id"]), telling_first([*keys, "seed", "name"])
    extra = ["path"] if paths and not routes else []

    def smallest(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.min("path").alias("path")) if extra else rows.select(*by).distinct()

    def moved(rows: DataFrame, to: str) -> DataFrame:
        path = [F.concat("path", F.array(to)).alias("path")] if extra else []
        return rows.select(*keys, "seed", F.col(to).alias("id"), *path)

    limit = steps.plain.rows_per_chunk

    def walk(start: DataFrame) -> None:
        since, before, depth = len(seen.paths), seen.total, 0
        frontier = seen.add(start)
        with Collected(name[::-1], limit) as passed:
            while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
                moving, plain = frontier.count(), steps.plain
                found = seen.total - before
                # few rows arrive from a small frontier: then a large table of known rows is searched for them, not shuffled
                few = found > limit and moving * 10 < found
                depth += 1
                if plain.large and not plain.placed and (few or _few_ids(frontier, moving, limit)):
                    ids = stage(frontier.select(*keys, "id").distinct(), f"{label}-ids-{depth}")
                    plain = plain.at(ids, f"{label}-steps-{depth}")
                    between.extend([ids, plain.table])
                    if steps.names is None and plain.table.isEmpty():
                        break
                if routes:
                    here = plain.probe(frontier.select(*keys, "seed", "id", "via"), moving)
                    arrived = here.select(*keys, "seed", F.col(steps.to).alias("id"), F.concat("via", F.array("id")).alias("via"))
                    known = seen.rows(since).select(*node, "rank")
                    if few:
                        arrived = stage(_first_routes(arrived, None, node, routes).select(*node, "via"), f"{label}-arrived-{depth}")
                        between.append(arrived)
                        at = arrived.select(*[F.col(c).alias(f"_{c}") for c in node])
                        known = known.join(at, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in node]), "left_semi")
                    kept = _first_routes(arrived, known, node, routes)
                    frontier = seen.add(kept.select(*keys, "seed", "id", F.lit(depth).alias("depth"), "rank", "via")).filter("rank = 1")
                    continue
                here = frontier.drop("depth")
                arrived = moved(plain.probe(here, moving), steps.to)
                if steps.names is not None:
                    called = smallest(steps.names.probe(here, moving).select(*name, *extra), name)
                    if passed.parts:
                        called = called.join(passed.rows(), name, "left_anti")
                    called = stage(called, f"{label}-names-{depth}")
                    between.append(called)
                    passed.add(called.select(*name))
                    arrived = arrived.unionByName(moved(steps.callers.probe(called, called.count()), "source"))
                arrived, known = smallest(arrived, node), seen.rows(since).select(*node)
                if few:
                    arrived = stage(arrived, f"{label}-arrived-{depth}")
                    between.append(arrived)
                    known = known.join(arrived.select(*node), node, "left_semi")
                fresh = arrived.join(known, node, "left_anti")
                frontier = seen.add(fresh.select(*keys, "seed", "id", F.lit(depth).alias("depth"), *extra))

    if turns > 1:
        turn = F.pmod(F.xxhash64("seed"), F.lit(turns))
        for i in range(turns):
            walk(start.filter(turn == i))
    else:
        walk(start)
    for table in between:
        unstage(table)
    return seen.rows()


def _few_ids(frontier: DataFrame, count: int, limit: int) -> bool:
    """Whether the rows of a large frontier stand at far fewer nodes, so that the steps of these are worth picking out."""
    return count * 4 > limit and frontier.agg(F.approx_count_distinct("id")).first()[0] * 8 < count


def _first_routes(arrived: DataFrame, known: DataFrame | None, node: list[str], limit: int) -> DataFrame:
    """Of the routes that arrive, those that are among their node's first ``limit``: ``(node, rank, via)``.

    Routes that are ``known`` come before them.  Equal routes count once.
    """
    order = [F.col("rank").asc_nulls_last(), "via"]
    rows = arrived.select(*node, F.lit(None).cast("int").alias("rank"), "via")
    if known is not None:
        rows = rows.unionByName(known.select(*node, "rank", F.lit(None).cast("array<string>").alias("via")))
    w = Window.partitionBy(*node).orderBy(*order)
    new = rows.withColumn("_rank", F.dense_rank().over(w)).filter((F.col("_rank") <= limit) & F.col("rank").isNull())
    new = new.withColumn("_before", F.lag("via").over(w)).filter(~F.col("via").eqNullSafe(F.col("_before")))
    return new.select(*node, F.col("_rank").alias("rank"), "via")


def _backwards(
    edges: DataFrame, types: Sequence[str], keys: Sequence[str], rows_per_chunk: int, label: str, hubs: CallHubs | None = None, resident: bool = True
) -> Steps:
    back = _reversed(edges, types, keys)
    plain = KeyedChunks(back, [*keys, "id"], ["dependent"], rows_per_chunk, label, resident, hasattr(edges, "_staged_at"))
    if hubs is None:
        return Steps(plain, "dependent")
    names = KeyedChunks(hubs.index, [*keys, "id"], ["name"], rows_per_chunk, f"{label}-index", True, hubs.staged)
    callers = KeyedChunks(hubs.wanted, [*keys, "name"], ["source"], rows_per_chunk, f"{label}-wanted", True, hubs.staged)
    return Steps(plain, "dependent", names, callers)


def blast_radius(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int = 6,
    types: Sequence[str] = EDGE_TYPES,
    keys: Sequence[str] = KEYS,
    paths: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    hubs: CallHubs | None = None,
    routes: int = 0,
) -> DataFrame:
    """``(seed, id, depth, severity[, path])`` of all nodes a change reaches.

    ``seeds(seed, id)`` may hold many changes at once, each with any number of
    source nodes.  Sources have depth 0.  With ``hubs`` the calls come in
    factored form and ``edges`` are its direct ones.  With ``routes`` there are up to so many
    rows per node, told apart by ``rank``, for :func:`witness_paths`: its first path, which has rank 1,
    and those after it, with the depth of the round that brought them.
    """
    if hubs is not None and "calls" not in types:
        hubs = None
    with _backwards(edges, types, keys, rows_per_chunk, "blast", hubs, resident=not routes) as steps:
        turns = ROUTE_TURNS if routes and steps.plain.large else 1
        found = reach(seeds, steps, keys, max_depth, paths, "blast", routes, turns)
    if routes:
        found = found.select(*keys, "seed", "id", "depth", "rank", F.concat("via", F.array("id")).alias("path"))
    return found.withColumn("severity", blast_severity(F.col("depth")))


def witness_paths(
    edges: DataFrame,
    affected: DataFrame,
    max_depth: int = 6,
    limit: int = 3,
    types: Sequence[str] = EDGE_TYPES,
    keys: Sequence[str] = KEYS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Up to ``limit`` routes per affected node: ``(seed, id, rank, path)``.

    The first is the node's own shortest path; the others extend the first
    path of another predecessor.  The order is by depth, then by path, so the
    choice does not depend on the order of rows.  Every round of a walk brings just
    the routes over the nodes it starts from, so a walk can keep them (``routes`` of :func:`blast_radius`);
    if ``affected`` holds them, they are not joined up a second time.
    """
    if "rank" in affected.columns:
        return affected.filter(F.col("rank") <= limit).select(*keys, "seed", "id", "path", "rank")
    steps = KeyedChunks(reverse_dependencies(edges, types, keys), [*keys, "id"], ["dependent"], rows_per_chunk, "routes")
    own = affected.filter("depth = 0").select(*keys, "seed", "id", F.lit(-1).alias("_depth"), "path")
    routes = steps.probe(affected.filter(F.col("depth") < max_depth).select(*keys, "seed", "id", "depth", "path")).select(
        *keys,
        "seed",
        F.col("dependent").alias("id"),
        F.col("depth").alias("_depth"),
        F.concat("path", F.array("dependent")).alias("path"),
    )
    return first_k(own.unionByName(routes), [*keys, "seed", "id"], ["_depth", "path"], limit).drop("_depth")


def impact_totals(affected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Affected nodes per change, sources left out."""
    return affected.groupBy(*keys, "seed").agg(F.count_if(F.col("depth") > 0).alias("total"))


def impact_by_depth(affected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return affected.groupBy(*keys, "seed", "depth").agg(F.count(F.lit(1)).alias("nodes"))


def impact_by_severity(affected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count per severity with zeros kept and sources left out."""
    counted = affected.groupBy(*keys, "seed").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in BLAST_SEVERITIES]
    )
    return counted.select(
        *keys,
        "seed",
        F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("nodes")) for s in BLAST_SEVERITIES])).alias("r"),
    ).select(*keys, "seed", "r.severity", "r.nodes")


_FORWARD = ("calls", "imports")


def entry_points_at_risk(
    entries: DataFrame,
    edges: DataFrame,
    affected: DataFrame,
    severities: DataFrame,
    keys: Sequence[str] = KEYS,
    types: Sequence[str] = _FORWARD,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``(seed, entry_point, risk)``: entries whose forward reach is hit.

    Walks backwards from the affected nodes instead of forwards from every
    entry.  A way to an affected node may be cut at the first one it meets, so
    the walk goes on only through nodes that are not affected (for high issues:
    that are not affected ones with a high issue).  Those keep at most two distinct
    affected nodes they reach: two are enough to know one that is not the node
    itself.  State stays linear in the graph and no entry-by-node pairs arise.
    Edges into nodes that are no entries and that nothing depends on are left out.
    ``severities(id, issue_severity)`` tells which nodes carry high issues.
    """
    keys = list(keys)
    node, at = telling_first([*keys, "seed", "id"]), telling_first([*keys, "id"])
    back = _reversed(edges, types, keys)
    roles = (
        entries.select(*keys, F.col("id").alias("dependent"), F.lit(True).alias("entry"))
        .unionByName(back.select(*keys, F.col("id").alias("dependent"), F.lit(False).alias("entry")))
        .groupBy(*telling_first([*keys, "dependent"]))
        .agg(F.max("entry").alias("entry"))
    )
    walk = back.join(roles, telling_first([*keys, "dependent"])).select(*keys, "id", "dependent", "entry")
    high = (
        severities.select(*keys, "id", "issue_severity")
        .dropDuplicates(at)
        .filter(F.col("issue_severity") == "high")
        .select(*keys, "id", F.col("id").alias("high"))
    )
    kinds = ("any", "high")
    with (
        KeyedChunks(walk, [*keys, "id"], ["dependent"], rows_per_chunk, "risk", resident=True) as steps,
        Collected(node[::-1], rows_per_chunk) as known,
        Collected(node[::-1], rows_per_chunk) as stops,
    ):
        onward = stage(steps.table.select(*at).distinct(), "risk-onward")
        # affected nodes that no step leads back from neither start a way nor end one
        marked = stage(
            affected.select(*keys, "seed", "id")
            .join(onward, at, "left_semi")
            .join(high, at, "left")
            .select(*keys, "seed", "id", F.col("id").alias("any"), "high"),
            "risk-0",
        )
        frontier, hits, rounds = marked, [], [onward, marked]
        while True:
            arrived = (
                steps.probe(frontier, frontier.count())
                .select(*keys, "seed", F.col("dependent").alias("id"), "entry", *[F.nullif(k, "dependent").alias(k) for k in kinds])
                .filter(F.coalesce(*kinds).isNotNull())
                .groupBy(*node)
                # of the arrivals, two distinct ones always hold one that is not known yet, if any is
                .agg(F.max("entry").alias("entry"), *[f(k).alias(f"{k}_{end}") for k in kinds for f, end in ((F.min, "a"), (F.max, "b"))])
            )
            arrived = stage(arrived, f"risk-{len(hits) + 1}")
            hits.append(arrived)
            rounds.append(arrived)
            moving = arrived.join(onward, at, "left_semi")
            if moving.isEmpty():
                break
            if not stops.parts:
                stops.add(marked)
            ends = stops.rows().groupBy(*node).agg(*[F.max(F.col(k).isNotNull()).alias(f"{k}_end") for k in kinds])
            moving = moving.join(ends, node, "left")
            if known.parts:
                held = known.rows().groupBy(*node).agg(*[F.collect_set(k).alias(f"{k}_held") for k in kinds])
                moving = moving.join(held, node, "left")
            else:
                moving = moving.withColumns({f"{k}_held": F.lit(None).cast("array<string>") for k in kinds})

            def news(k: str):
                none = F.expr("CAST(array() AS array<string>)")
                held = F.coalesce(f"{k}_held", none)
                new = F.array_except(F.array_distinct(F.array_compact(F.array(f"{k}_a", f"{k}_b"))), held)
                stopped = F.coalesce(f"{k}_end", F.lit(False))
                return F.when(~stopped, F.slice(new, 1, F.greatest(F.lit(0), F.lit(2) - F.size(held)))).otherwise(none).alias(k)

            fresh = moving.select(*node, F.explode(F.arrays_zip(*[news(k) for k in kinds])).alias("w"))
            frontier = stage(fresh.select(*keys, "seed", "id", *[F.col("w")[k].alias(k) for k in kinds]), f"risk-moving-{len(hits)}")
            rounds.append(frontier)
            if frontier.isEmpty():
                break
            known.add(frontier)
    found = _union(hits).filter("entry").select(*node, F.col("high_a").isNotNull().alias("high"))
    if len(hits) > 1:
        found = _settled(found.groupBy(*node).agg(F.max("high").alias("high")), rounds, "at-risk")
    else:
        for part in rounds:
            if part is not hits[0]:
                unstage(part)
    return found.select(
        *keys, "seed", F.col("id").alias("entry_point"), F.when(F.col("high"), "high").otherwise("medium").alias("risk")
    )


def affected_by_entry(
    entries: DataFrame,
    edges: DataFrame,
    affected: DataFrame,
    keys: Sequence[str] = KEYS,
    types: Sequence[str] = _FORWARD,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``(seed, entry_point, id)``: every affected node each entry reaches.

    The full listing behind :func:`entry_points_at_risk`; its size is the
    number of such pairs.  Edges that lead to no affected node are dropped
    first, by a walk backwards that keeps the edges it takes, then all entries walk forwards together.
    """
    keys = list(keys)
    at = telling_first([*keys, "id"])
    useful, forward = StagedRounds(edges.sparkSession, "useful"), StagedRounds(edges.sparkSession, "forward")
    with _backwards(edges, types, keys, rows_per_chunk, "prune") as steps:
        frontier = useful.add(affected.select(*keys, "id").distinct())
        while True:
            # a target that reaches an affected node makes its source one that does
            leading = steps.plain.probe(frontier, frontier.count()).select(*keys, F.col("dependent").alias("id"), F.col("id").alias("next"))
            fresh = forward.add(leading).select(*at).distinct().join(useful.rows(), at, "left_anti")
            frontier = useful.add(fresh.select(*keys, "id"))
            if frontier.isEmpty():
                break
    start = entries.select(*keys, "id").distinct().join(useful.rows(), at, "left_semi")
    walks = KeyedChunks(forward.rows(), [*keys, "id"], ["next"], rows_per_chunk, "forward", resident=True, staged=True)
    with Steps(walks, "next") as steps:
        walked = reach(start.select(*keys, F.col("id").alias("seed"), "id"), steps, keys, None, label="forward")
    for rounds in (useful, forward):
        unstage(rounds.rows())
    pairs = walked.filter(F.col("id") != F.col("seed")).select(*keys, F.col("seed").alias("entry_point"), "id")
    met = stage(pairs.select(*at).distinct(), "met")
    hit = stage(affected.select(*keys, "seed", "id").join(met, at, "left_semi").distinct(), "met-affected")
    unstage(met)
    return pairs.join(hit, at).select(*keys, "seed", "entry_point", "id")


def neighbourhood(
    nodes: DataFrame, edges: DataFrame, limit: int = 5, keys: Sequence[str] = KEYS, of: DataFrame | None = None
) -> DataFrame:
    """First callers, callees and importers of every node, as sorted arrays.

    With ``of(id)`` the rows of these nodes only: for a join with them, which would drop the others.
    """
    keys = list(keys)
    if of is not None:
        of = of.select(*keys, "id").distinct()
        nodes = nodes.join(of, telling_first([*keys, "id"]), "left_semi")

    def listed(rows: DataFrame, name: str, at: DataFrame | None) -> DataFrame:
        if at is not None:
            rows = rows.join(at, telling_first([*keys, "id"]), "left_semi")
        # equal rows share a rank, so groups are cut before the shuffle without a shuffle to find them
        w = Window.partitionBy(*telling_first([*keys, "id"])).orderBy("other")
        top = rows.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= limit)
        return top.groupBy(*keys, "id").agg(F.sort_array(F.collect_set("other")).alias(name))

    calls = edges.filter(F.col("type") == "calls")
    callers = listed(calls.select(*keys, F.col("target").alias("id"), F.col("source").alias("other")), "callers", of)
    callees = listed(calls.select(*keys, F.col("source").alias("id"), F.col("target").alias("other")), "callees", of)
    importers = listed(
        edges.filter(F.col("type") == "imports").select(*keys, F.col("target").alias("id"), F.col("source").alias("other")),
        "importers",
        None if of is None else nodes.select(*keys, F.col("file").alias("id")).distinct(),
    ).withColumnRenamed("id", "file")
    none = F.expr("CAST(array() AS array<string>)")
    base = nodes.select(*keys, "id", "file").join(callers, [*keys, "id"], "left").join(callees, [*keys, "id"], "left")
    joined = base.join(importers, [*keys, "file"], "left")
    return joined.select(
        *keys, "id", *[F.coalesce(c, none).alias(c) for c in ("callers", "callees", "importers")]
    )


def impact_payload(affected: DataFrame, at_risk: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Long form of a change's payload: ``(seed, item, id, value)``.

    Items are ``affected_count`` (one row), ``critical_node`` and
    ``broken_pipeline`` with its risk.  Rows instead of one nested document
    keep a change of any size out of a single task.
    """
    count = impact_totals(affected, keys).select(
        *keys, "seed", F.lit("affected_count").alias("item"), F.lit("").alias("id"), F.col("total").cast("string").alias("value")
    )
    critical = affected.filter(F.col("severity") == "critical").select(
        *keys, "seed", F.lit("critical_node").alias("item"), "id", F.lit("critical").alias("value")
    )
    broken = at_risk.select(
        *keys, "seed", F.lit("broken_pipeline").alias("item"), F.col("entry_point").alias("id"), F.col("risk").alias("value")
    )
    return count.unionByName(critical).unionByName(broken)


def risk_level(responses: DataFrame, column: str = "response") -> DataFrame:
    """Add ``risk_level`` as named in the response, with a default."""
    found = F.upper(F.regexp_extract(column, r"(?i)RISK_LEVEL:\s*(" + "|".join(RISK_LEVELS) + ")", 1))
    return responses.withColumn("risk_level", F.coalesce(F.nullif(found, F.lit("")), F.lit(DEFAULT_RISK)))


def cascade(affected: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS, critical: int = 4, high: int = 3) -> DataFrame:
    """Short report per change: first direct and second-level nodes, and how
    many more there are.

    ``(seed, level, rank, id, label, more)``; the row of rank 0 carries the
    count that is not listed.
    """
    keys = list(keys)
    limits = F.when(F.col("severity") == "critical", critical).when(F.col("severity") == "high", high)
    listed = first_k(
        affected.filter(F.col("severity").isin("critical", "high")), [*keys, "seed", "severity"], ["id"], max(critical, high)
    ).filter(F.col("rank") <= limits)
    named = listed.join(nodes.select(*keys, "id", "label"), [*keys, "id"], "left").select(
        *keys, "seed", F.col("severity").alias("level"), "rank", "id", F.coalesce("label", "id").alias("label"), F.lit(0).cast("long").alias("more")
    )
    counts = affected.groupBy(*keys, "seed").agg(
        F.greatest(F.count_if(F.col("severity") == "critical") - critical, F.lit(0)).alias("critical"),
        F.greatest(F.count_if(F.col("severity") == "high") - high, F.lit(0)).alias("high"),
        F.count_if(F.col("depth") >= 3).alias("transitive"),
    )
    rest = counts.select(
        *keys,
        "seed",
        F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("more")) for c in ("critical", "high", "transitive")])).alias("r"),
    ).select(
        *keys, "seed", "r.level", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label"), "r.more"
    )
    return named.unionByName(rest)


def edge_impact(edges: DataFrame, affected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class of every edge under one change.

    Both ends hit: the source's severity (medium covers the rest); one end
    hit: dim; no end hit: hidden.  ``affected`` holds one change per
    repository.
    """
    keys = list(keys)
    hit = affected.select(*keys, "id", "severity")
    joined = edges.join(
        hit.select(*keys, F.col("id").alias("source"), F.col("severity").alias("_from")), [*keys, "source"], "left"
    ).join(hit.select(*keys, F.col("id").alias("target"), F.col("severity").alias("_to")), [*keys, "target"], "left")
    both = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    one = F.col("_from").isNotNull() | F.col("_to").isNotNull()
    impact = (
        F.when(both, F.when(F.col("_from").isin("critical", "high"), F.col("_from")).otherwise("medium"))
        .when(one, "dim")
        .otherwise("hidden")
    )
    return joined.select(*keys, "source", "target", "type", impact.alias("impact"))


def impact_prompt_parts(
    changes: DataFrame,
    nodes: DataFrame,
    context: DataFrame,
    affected: DataFrame,
    at_risk: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The prompt of every proposed change ``(seed, id, change)`` as parts.

    ``(seed, part, item, text)``: facts (1), one row per direct dependent (2),
    one row per pipeline at risk (3), neighbourhood (4) and closing (5).  Read
    in the order of ``part`` and ``item`` they are the whole prompt; as rows, a
    change with millions of dependents passes through no single task.
    """
    keys = list(keys)
    payload = impact_payload(affected, at_risk, keys)
    wanted = changes.select(*keys, "seed")
    facts = (
        changes.join(nodes.select(*keys, "id", "type", "file", "summary"), [*keys, "id"])
        .join(context, [*keys, "id"])
        .join(impact_totals(affected, keys), [*keys, "seed"], "left")
    )

    def listed(name: str):
        return F.concat(F.lit("["), F.array_join(name, ", "), F.lit("]"))

    head = F.concat(
        F.lit("Repository: "), F.col("repo"),
        F.lit("\nChanged node: "), F.col("id"),
        F.lit("\nType: "), F.col("type"),
        F.lit("\nSummary: "), F.col("summary"),
        F.lit("\nFile: "), F.col("file"),
        F.lit("\nProposed change: "), F.col("change"),
        F.lit("\nAffected nodes: "), F.coalesce("total", F.lit(0)).cast("string"),
    )
    around = F.concat(
        F.lit("Called by: "), listed("callers"),
        F.lit("\nCalls: "), listed("callees"),
        F.lit("\nImported by: "), listed("importers"),
    )
    levels = "|".join(RISK_LEVELS)
    closing = f"First the dependents that fail once this change lands, then the tests that would show it. The last line reads RISK_LEVEL: [{levels}]"
    parts = F.array(
        F.struct(F.lit(1).alias("part"), head.alias("text")),
        F.struct(F.lit(4).alias("part"), around.alias("text")),
        F.struct(F.lit(5).alias("part"), F.lit(closing).alias("text")),
    )
    fixed = facts.select(*keys, "seed", F.explode(parts).alias("p")).select(
        *keys, "seed", "p.part", F.lit("").alias("item"), "p.text"
    )
    critical = F.col("item") == "critical_node"
    lists = (
        payload.filter(F.col("item") != "affected_count")
        .join(wanted, [*keys, "seed"], "left_semi")
        .select(
            *keys,
            "seed",
            F.when(critical, 2).otherwise(3).alias("part"),
            F.col("id").alias("item"),
            F.when(critical, F.concat(F.lit("Direct dependent: "), "id"))
            .otherwise(F.concat(F.lit("Pipeline at risk: "), "id", F.lit(" ("), "value", F.lit(")")))
            .alias("text"),
        )
    )
    return fixed.unionByName(lists)
