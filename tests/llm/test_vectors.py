import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import vectors as v
from tributary.llm.queries import op5_nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, score string, part string"


def brute(rows, k=5):
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    good = {(i, tuple(x)): x for i, x in good}
    out = set()
    for (i, _), q in good.items():
        if i % 50 == 0:
            near = sorted((-(q @ x) / np.linalg.norm(q) / np.linalg.norm(x), j) for (j, _), x in good.items() if j != i and len(x) == len(q))
            out |= {(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near[:k])}
    return out


def test_odd_vectors_ties_and_few_candidates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(0, 120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(30)] + [(350, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]), (400, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0])]
    rows += [(500, None), (501, []), (550, [0.0] * 6), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (650, [float("nan")] * 6), (700, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    rows += [(1000, [1.0, 1.0]), (1001, [1.0, 0.5]), (1002, [-0.0, 3.0]), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, x, "other", "other") for i, x in rows], SCHEMA)
    got = v.nearest(docs, F.col("vec_id") % 50 == 0, per_query=100).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got} == brute([(i, None if x is None else [c if c is None else float(np.float32(c)) for c in x]) for i, x in rows])
    assert len(got) == len({(r["query_id"], r["rank"]) for r in got})
    assert v.nearest(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("rows", [300, 50])
def test_small_blocks_lose_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(v, "BLOCK_ROWS", rows)
    monkeypatch.setattr(v, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    docs = spark.createDataFrame([(i, x, "", "") for i, x in data], SCHEMA)
    got = v.nearest(docs, F.col("vec_id") % 50 == 0, per_query=100).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got} == brute([(i, np.float32(x).astype(float).tolist()) for i, x in data])


def test_partitions_are_balanced_and_learned():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 24)) * 3
    data = np.concatenate([c + rng.normal(size=(100, 24)) for c in centres])[rng.permutation(1600)]
    router = v.train(data, 16)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sizes = np.bincount(router.route(unit, 1)[:, 0], minlength=16)
    assert sizes.max() <= 250 and router.probes <= 6


def test_recall(spark):
    folder = "/root/testdata/sf0.1"
    got = op5_nearest_vectors(spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in rows])
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len({(q, c) for q, _, c, _ in want} & found) / len(want) >= 0.9
