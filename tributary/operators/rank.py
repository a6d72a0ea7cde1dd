"""Centrality of nodes by the power method, per repository."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.graph import CallHubs
from tributary.session import KEYS, ROWS_PER_CHUNK, KeyedChunks, stage, telling_first, unstage


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    keys: Sequence[str] = KEYS,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1e-6,
    digits: int | None = 4,
    iterations: int | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    hubs: CallHubs | None = None,
) -> DataFrame:
    """``(keys, id, centrality)`` over all edge types, direction kept.

    Each repository is normalised by itself.  Nodes without outgoing edges
    spread their rank evenly.  A repository stops once its summed change falls
    below ``tol`` times its node count and leaves the loop; one that has not
    settled after ``max_iter`` rounds keeps 0.0.  ``iterations`` runs a fixed
    number of rounds instead.  With ``hubs`` the calls come in factored form
    and ``edges`` are its direct ones; a name collects the shares of its
    callers once and hands the sum to each candidate.

    Nodes, repositories and called names get numbers first.  The rounds sort, join and
    sum by these alone; the ids come back at the end.

    One round is one job.  Edges stay partitioned on the executors, ranks join
    them there, and only partial sums per target cross the wire.  The new ranks
    go to shared storage, which cuts the lineage.  Per-repository totals meet
    the nodes on (repository, slice): a large repository has many slices, a
    small one has one.
    """
    keys = list(keys)
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("slices", F.ceil(F.col("n") / rows_per_chunk).cast("int"))
    repos = stage(sizes.withColumn("repo_no", F.monotonically_increasing_id()), "rank-sizes")
    sizes = repos.select("repo_no", "n", "slices")
    # The numbers hold once they are written.
    numbered = nodes.groupBy(*telling_first([*keys, "id"])).agg(F.count(F.lit(1)).alias("copies")).join(repos, keys)
    numbered = stage(numbered.withColumn("node", F.monotonically_increasing_id()), "rank-nodes")

    def from_known(table: DataFrame) -> DataFrame:
        """The rows of ``table`` whose source is a node, with its number."""
        known = numbered.select(*keys, F.col("id").alias("source"), "node")
        return table.join(known, telling_first([*keys, "source"])).drop("source")

    def to_known(table: DataFrame, how: str) -> DataFrame:
        """``table`` with the number of its target; null meets null, as in the sums of a round."""
        known = numbered.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_id"), F.col("node").alias("to"))
        same = [F.col("target").eqNullSafe(F.col("_id")), *[F.col(k) == F.col(f"_{k}") for k in keys[::-1]]]
        return table.join(known, same, how).drop(*[f"_{k}" for k in keys], "_id")

    with ExitStack() as loop:

        def resident(table: DataFrame, by: str, spread: Sequence[str], label: str) -> KeyedChunks:
            return loop.enter_context(KeyedChunks(table, [by], spread, rows_per_chunk, label, True))

        # What ends in a join is written at once: such a join may be split where a key is hot.
        pairs = to_known(from_known(edges.select(*keys, "source", "target")), "left")
        # Targets that are no nodes take their share of the rank out of the graph.
        pairs = stage(pairs.select("node", "to", F.when(F.col("to").isNull(), F.col("target")).alias("elsewhere")), "rank-pairs")
        out = resident(pairs.distinct(), "node", ["to", "elsewhere"], "rank-edges")
        unstage(pairs)
        links = out.table.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        if hubs is not None:
            by_name = telling_first([*keys, "name"])
            names = hubs.index.groupBy(*by_name).agg(F.count(F.lit(1)).alias("links"))
            names = stage(names.withColumn("name_no", F.monotonically_increasing_id()), "rank-names")
            loop.callback(unstage, names)
            calls = from_known(hubs.wanted.select(*keys, "source", "name").join(names, by_name))
            wanted = resident(calls.select("node", "name_no", "links"), "node", ["name_no"], "rank-wanted")
            heard = names.join(wanted.table.select("name_no").distinct(), "name_no", "left_semi").select(*keys, "name", "name_no")
            found = to_known(hubs.index.select(*keys, "name", F.col("id").alias("target")).join(heard, by_name), "inner")
            index = resident(found.select("name_no", "to"), "name_no", ["to"], "rank-index")
            links = links.unionByName(wanted.table.select("node", "links"))
        degree = links.groupBy("node").agg(F.sum("links").alias("degree"))

        # A node that is given twice starts with both shares.
        base = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        state = stage(
            base.join(degree, "node", "left").select(
                "node",
                "repo_no",
                F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"),
                F.coalesce("degree", F.lit(0)).alias("degree"),
                (F.lit(1.0) / F.col("n")).alias("rank"),
            ),
            "rank-0",
        )

        def per_slice(rows: DataFrame) -> DataFrame:
            return rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

        def flows(shares: DataFrame) -> DataFrame:
            sent = out.probe(shares).filter("to is not null").select(F.col("to").alias("node"), "share")
            if hubs is None:
                return sent
            held = wanted.probe(shares).groupBy("name_no").agg(F.sum("share").alias("share"))
            return sent.unionByName(index.probe(held).select(F.col("to").alias("node"), "share"))

        finished: list[DataFrame] = []
        fixed = iterations is not None
        for i in range(1, (iterations if fixed else max_iter) + 1):
            shares = state.filter("degree > 0").select("node", (F.col("rank") / F.col("degree")).alias("share"))
            own = state.select("node", F.lit(0.0).alias("share"), "repo_no", "slice", "degree", F.col("rank").alias("prev"))
            sums = own.unionByName(flows(shares), allowMissingColumns=True).groupBy("node").agg(
                F.sum("share").alias("share"), *(F.max(c).alias(c) for c in ("repo_no", "slice", "degree", "prev"))
            )
            loose = state.filter("degree = 0").groupBy("repo_no").agg(F.sum("rank").alias("loose"))
            totals = per_slice(sizes.join(loose, "repo_no", "left").na.fill(0.0, ["loose"]))
            rank = F.lit(alpha) * (F.col("share") + F.col("loose") / F.col("n")) + F.lit(1 - alpha) / F.col("n")
            before, state = state, stage(
                sums.join(totals, ["repo_no", "slice"]).select("node", "repo_no", "slice", "degree", rank.alias("rank"), "prev"), f"rank-{i}"
            )
            unstage(before)
            if fixed:
                continue
            change = state.groupBy("repo_no").agg(F.sum(F.abs(F.col("rank") - F.col("prev"))).alias("change"))
            settled = stage(
                sizes.join(change, "repo_no").filter(F.col("change") < F.col("n") * tol).select("repo_no", "slices"), f"rank-settled-{i}"
            )
            if settled.isEmpty():
                unstage(settled)
            else:
                done = per_slice(settled)
                finished.append(state.join(done, ["repo_no", "slice"], "left_semi").select("node", "rank"))
                state = stage(state.join(done, ["repo_no", "slice"], "left_anti"), f"rank-open-{i}")
                if state.isEmpty():
                    break
    result = state.select("node", (F.col("rank") if fixed else F.lit(0.0)).alias("rank"))
    for part in finished:
        result = result.unionByName(part)
    value = F.col("rank") if digits is None else F.round("rank", digits)
    return result.join(numbered.select("node", *keys, "id"), "node").select(*keys, "id", value.alias("centrality"))
