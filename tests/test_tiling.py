import math
import random

from pyspark.sql import functions as F

from tributary.operators import extremes, graph, hull, tiling

CALLS = "repo string, commit_sha string, path string, caller_function string, line int, callee string"
SYMBOLS = "repo string, commit_sha string, path string, id string, name string"


def test_both_sides_of_a_hot_name_are_cut(spark):
    """5,000 callers of a name with 5,000 definitions: 25 million pairs, in tiles of 500 by 500."""
    callers, definitions = spark.range(5000), spark.range(5000)
    left = callers.select(F.lit("get").alias("name"), F.col("id").alias("caller"))
    right = definitions.select(F.lit("get").alias("name"), F.col("id").alias("definition"))
    cut = tiling.tiles(left, right, ["name"], 500).first()
    assert (cut["_rows"], cut["_columns"]) == (10, 10)
    joined = tiling.tiled_join(left, right, ["name"], ["caller"], ["definition"], tile=500)
    got = joined.agg(F.count("*").alias("n"), F.sum("caller").alias("a"), F.sum("definition").alias("b"), F.bit_xor(F.xxhash64("caller", "definition")).alias("x")).first()
    assert (got["n"], got["a"], got["b"]) == (25_000_000, 5000 * sum(range(5000)), 5000 * sum(range(5000)))
    plain = left.crossJoin(right.drop("name")).agg(F.bit_xor(F.xxhash64("caller", "definition"))).first()[0]
    assert got["x"] == plain
    hashed = lambda df, c: df.groupBy(F.pmod(F.xxhash64(c), F.lit(10))).count().agg(F.max("count")).first()[0]
    assert hashed(left, "caller") < 650 and hashed(right, "definition") < 650


def test_tiles_keep_every_pair_once(spark):
    rnd = random.Random(1)
    keys = ["a"] * 40 + ["b"] * 7 + ["c", None, "only left"]
    left = [(rnd.choice(keys), i) for i in range(300)]
    right = [(rnd.choice([*keys[:-1], "only right"]), i) for i in range(300)]
    want = sorted((k, i, j) for k, i in left for other, j in right if k is not None and k == other)
    for tile in (3, 50, 10**6):
        joined = tiling.tiled_join(spark.createDataFrame(left, "k string, l int"), spark.createDataFrame(right, "k string, r int"), ["k"], ["l"], ["r"], tile)
        assert joined.columns == ["k", "l", "r"] and sorted(map(tuple, joined.collect())) == want
    none = spark.createDataFrame([], "k string, r int")
    assert tiling.tiled_join(spark.createDataFrame(left, "k string, l int"), none, ["k"], ["l"], ["r"]).count() == 0


def test_call_edges_in_tiles(spark):
    calls = [("r", "c", f"f{i % 9}.py", f"caller_{i}", i, "x.get" if i % 3 else "put") for i in range(200)]
    symbols = [("r", "c", f"g{i}.py", f"g{i}.py::get", "get") for i in range(60)] + [("r", "c", "p.py", "p.py::put", "put")]
    calls, index = spark.createDataFrame(calls, CALLS), graph.name_index(spark.createDataFrame([], SYMBOLS), spark.createDataFrame(symbols, SYMBOLS))
    whole, cut = (graph.call_edges(calls, index, rows_per_chunk=n) for n in (10**6, 7))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    assert whole.count() == 60 * sum(1 for i in range(200) if i % 3) + sum(1 for i in range(200) if not i % 3)


def test_few_points_are_left_for_the_hull(spark):
    rnd = random.Random(3)
    square = [("s", rnd.random(), rnd.random()) for _ in range(20_000)]
    disc = [("d", math.sqrt(r) * math.cos(t), math.sqrt(r) * math.sin(t)) for r, t in ((rnd.random(), rnd.random() * 7) for _ in range(20_000))]
    points = spark.createDataFrame(square + disc, "k string, x double, y double")
    assert extremes.outer_points(points, ["k"]).count() < 0.05 * 40_000
    for name, rows in (("s", square), ("d", disc)):
        got = [(r.x, r.y) for r in hull.hulls(points, ["k"]).filter(F.col("k") == name).orderBy("seq").collect()]
        assert got == hull.ring([(x, y) for _, x, y in rows])


def test_hulls_of_flat_and_tiny_groups(spark):
    rnd = random.Random(6)
    groups = {
        "line": [(i, 2 * i) for i in range(50)], "one": [(3, 3)], "same": [(1, 1)] * 30, "two": [(0, 0), (5, 5)],
        "grid": [(i % 10, i // 10) for i in range(100)], "far": [(rnd.random() * 1e9, 1e9 + rnd.random()) for _ in range(300)], None: [(0, 0), (4, 0), (2, 1), (2, 3)],
    }
    rows = [(k, float(x), float(y)) for k, points in groups.items() for x, y in points]
    got = {}
    for r in hull.hulls(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).filter("k is not null").orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    for k, points in groups.items():
        if k is not None:
            assert got.get(k, []) == (hull.ring([(float(x), float(y)) for x, y in points]) if len(points) > 1 else []), k
