"""Approximate nearest neighbours: learned partitions.

A neighbour graph of a bounded sample is cut into balanced partitions, and a small
classifier learns which vectors belong where.  Every vector of the table is indexed in
the partition that the classifier finds most probable; a query goes to its several most
probable partitions and is ranked there by exact cosines.

Equal vectors are indexed once, with their smallest ids.  Partitions are dealt out in
blocks of bounded size, so one that holds a large share of the table is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import staged

#: Sampled vectors per partition, and in all at most.
SAMPLE_PER_PART, SAMPLE = 64, 8192
NEIGHBOURS = 10
#: Rows of the index, and queries, that meet in one task at most, give or take the evenness of a hash.
BLOCK_ROWS, BLOCK_QUERIES = 4000, 20_000
#: Share of the nearest sampled vectors that the partitions searched must hold, over sampled vectors kept out of training.
COVER = 0.95


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    out = np.zeros((len(unit), k), np.int64)
    for a in range(0, len(unit), 512):
        near = unit[a : a + 512] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        out[a : a + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Cut the graph into parts of nearly equal size, with few edges between them.

    Median splits along directions of large spread give an even start; then vertices
    move to the part that most of their neighbours are in, while it has room.
    """
    label = np.zeros(len(unit), np.int64)
    todo = [(np.arange(len(unit)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        mine = unit[rows] - unit[rows].mean(0)
        axis = rng.normal(size=unit.shape[1])
        for _ in range(6):
            axis = mine.T @ (mine @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        order = rows[np.argsort(mine @ axis, kind="stable")]
        left = n // 2
        cut = len(order) * left // n
        todo += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    room = int(np.ceil(len(unit) / parts * 1.3))
    fewest = int(len(unit) / parts * 0.5)
    both = [np.concatenate(x) for x in (
        (np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()), (graph.ravel(), np.repeat(np.arange(len(graph)), graph.shape[1])))]
    for _ in range(rounds):
        votes = np.zeros((len(unit), parts), np.int32)
        np.add.at(votes, (both[0], label[both[1]]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(len(unit)), want] - votes[np.arange(len(unit)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[want[v]] < room and size[label[v]] > fewest:
                size[label[v]] -= 1
                size[want[v]] += 1
                label[v] = want[v]
                moved += 1
        if moved < len(unit) // 1000 + 1:
            break
    return label


@dataclass
class Router:
    """A network of one hidden layer from unit vectors to partitions; vectors of another length have a partition of their own."""

    dimensions: int
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    probes: int = 1

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def route(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The most probable partitions of each row, the first one first."""
        scores = self.logits(unit)
        probes = min(probes, scores.shape[1])
        top = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)


def train(vectors: np.ndarray, parts: int, steps: int = 500, width: int = 128, seed: int = 5) -> Router:
    """Partition the neighbour graph of the sample and learn the partitions.

    A sixth of the sample is kept out to find how many partitions must be searched: as
    few as hold enough of its neighbours.
    """
    rng = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else vectors
    dimensions = unit.shape[1]
    held, unit = unit[: len(unit) // 6], unit[len(unit) // 6 :]
    parts = max(1, min(parts, len(unit) // 8))
    if parts == 1:
        return Router(dimensions, np.zeros((dimensions, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(unit, min(NEIGHBOURS, len(unit) - 1))
    label = balanced_parts(unit, graph, parts, rng)
    weights = [rng.normal(0, (2 / dimensions) ** 0.5, (dimensions, width)), np.zeros(width), rng.normal(0, (1 / width) ** 0.5, (width, parts)), np.zeros(parts)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(unit), min(1024, len(unit)))
        x = unit[rows] * dimensions**0.5
        h = np.maximum(x @ weights[0] + weights[1], 0)
        z = h @ weights[2] + weights[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        # The target is where the row's neighbours are, itself included: it teaches second choices too.
        target = np.zeros_like(p)
        np.add.at(target, (np.repeat(np.arange(len(rows)), graph.shape[1]), label[graph[rows]].ravel()), 0.5 / graph.shape[1])
        target[np.arange(len(rows)), label[rows]] += 0.5
        d = (p - target) / len(rows)
        dh = (d @ weights[2].T) * (h > 0)
        for w, g, (m, v) in zip(weights, (x.T @ dh, dh.sum(0), h.T @ d, d.sum(0)), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(dimensions, weights[0] * dimensions**0.5, weights[1], weights[2], weights[3])
    home = router.logits(unit).argmax(1)  # where the index will hold a vector
    rank = np.argsort(np.argsort(-router.logits(held), axis=1, kind="stable"), axis=1)
    near = held @ unit.T
    k = min(5, len(unit))
    found = np.take_along_axis(rank, home[np.argpartition(-near, k - 1, axis=1)[:, :k]], 1)
    router.probes = int(np.quantile(found, COVER, method="higher")) + 1
    return router


def _units(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]), np.diff(np.concatenate([[0], ends]))


def _routed(router: Router, probes: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lengths = _units(batch.column("vector"))
            parts: list[list[int]] = [[-int(n)] for n in lengths]
            same = np.flatnonzero(lengths == router.dimensions)
            if len(same):
                x = np.stack([rows[i] for i in same])
                for i, p in zip(same.tolist(), router.route(x / np.linalg.norm(x, axis=1, keepdims=True), probes).tolist(), strict=True):
                    parts[i] = p
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(parts, pa.list_(pa.int32()))], [*names, "parts"])

    return run


def _rank(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Exact cosines of the queries and the rows that meet in a block; the best ``k + 1`` classes of each query."""

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("vector").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if rows.num_rows and queries.num_rows:
            x, q = matrix(rows), matrix(queries)
            length, least = np.linalg.norm(x, axis=1), rows.column("least").to_numpy()
            top = min(k + 1, len(x))
            for a in range(0, len(q), 512):
                part = q[a : a + 512]
                score = part @ x.T / (np.linalg.norm(part, axis=1)[:, None] * length)
                edge = -np.partition(-score, top - 1, axis=1)[:, top - 1 : top]
                i, j = np.nonzero(score >= edge)  # ties at the edge too
                order = np.lexsort((least[j], -score[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < top], j[place < top]
                out.append(pa.table({
                    "query": queries.column("key").take(pa.array(a + i)), "least": pa.array(least[j]), "ids": rows.column("ids").take(pa.array(j)),
                    "score": pa.array(score[i, j]),
                }))
        return pa.concat_tables(out) if out else pa.table({
            "query": pa.array([], pa.binary()), "least": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", per_query: float = 1.0) -> DataFrame:
    """The ``k`` nearest found rows of each query by cosine, ties to the smaller id: ``query_id, rank, vec_id, score``.

    Queries are the rows for which ``is_query`` holds; all other rows than the query's
    own (those with its id) are candidates.  Rows without an id, and vectors that are
    null, zero or hold null or non-finite components take no part; vectors of different
    lengths are not compared.  Rows equal in id and vector count once.  With fewer than
    ``k`` candidates all found come back; an empty table gives no rows.  Other columns
    are ignored.  ``per_query`` scales the number of partitions searched.
    """
    values = F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), values.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    key = F.unhex(F.md5(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))))
    rows = staged(rows.withColumn("key", key).distinct(), "vectors").frame
    some = Window.partitionBy("key").orderBy("id")
    # Of equal vectors, k + 1 ids are enough for any query: its own may be one of them.
    classes = staged(
        rows.withColumn("at", F.row_number().over(some)).filter(F.col("at") <= k + 1)
        .groupBy("key").agg(F.any_value("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("least", F.col("ids")[0]),
        "classes",
    ).frame
    total = classes.count()
    usual = classes.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimensions = usual["n"] if usual else 1
    parts = max(1, 2 ** round(np.log2(max(total, 1) ** 0.5 / 2)))
    fit_on = min(SAMPLE, SAMPLE_PER_PART * parts)
    sample = classes.filter(F.size("vector") == dimensions).orderBy("key").limit(fit_on).select("vector").toArrow()
    router = train(np.array(sample.column("vector").to_pylist(), float).reshape(sample.num_rows, dimensions), parts)
    probes = max(1, round(router.probes * per_query))

    indexed = staged(
        classes.select("key", "vector", "ids", "least").mapInArrow(
            _routed(router, 1, ["key", "vector", "ids", "least"]), "key binary, vector array<double>, ids array<long>, least long, parts array<int>"
        ).withColumn("part", F.col("parts")[0]).drop("parts"),
        "index",
    ).frame
    asked = rows.filter("asks").select("key", "vector").dropDuplicates(["key"])
    sent = staged(
        asked.mapInArrow(_routed(router, probes, ["key", "vector"]), "key binary, vector array<double>, parts array<int>")
        .withColumn("part", F.explode("parts")).drop("parts"),
        "queries",
    ).frame
    # One row per partition; their number is bounded by the square root of the table's size.
    blocks = F.broadcast(
        indexed.groupBy("part").agg(F.count("*").alias("n")).join(sent.groupBy("part").agg(F.count("*").alias("q")), "part")
        .select("part", F.ceil(F.col("n") / BLOCK_ROWS).alias("n"), F.ceil(F.col("q") / BLOCK_QUERIES).alias("q"))
    )
    spread = F.xxhash64("key")
    left = indexed.join(blocks, "part").withColumn("block", F.pmod(spread, "n")).withColumn("asks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
    right = sent.join(blocks, "part").withColumn("asks", F.pmod(spread, "q")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    keys = ["part", "block", "asks"]
    met = left.select(*keys, "vector", "ids", "least").groupBy(*keys).cogroup(right.select(*keys, "key", "vector").groupBy(*keys)).applyInArrow(
        _rank(k), "query binary, least long, ids array<long>, score double"
    )
    top = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    best = met.withColumn("at", F.row_number().over(top)).filter(F.col("at") <= k + 1).select("query", "ids", "score")
    own = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("key").alias("query")).distinct()
    found = own.join(best, "query").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
