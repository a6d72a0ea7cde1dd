import hashlib
from collections import defaultdict

from llm_fixtures import ODD, documents, prose

from tributary.llm.sharding import directory, shards, write_shards


def brute(rows, limit):
    """Split buckets one bit at a time."""
    held = [(k, n, format(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), "060b")) for k, n in rows]
    out, todo = {}, [("", held)]
    while todo:
        prefix, mine = todo.pop()
        if sum(n for _, n, _ in mine) <= limit:
            out.update({k: prefix for k, _, _ in mine})
        else:
            for bit in "01":
                todo.append((prefix + bit, [r for r in mine if r[2].startswith(prefix + bit)]))
    return out


def test_against_splitting_one_bit_at_a_time(spark):
    texts = [*ODD[:5], *(prose(3 + i % 40, i) for i in range(300))]
    docs = documents(spark, texts, clash=("shard", "h", "root", "n_bytes", "depth")).repartition(3)
    sizes = [(i, len((t or "").encode())) for i, t in enumerate(texts)]
    for limit in (400, 3000, 10**9):
        got = {r["doc_id"]: r for r in shards(docs, limit).collect()}
        assert {k: r["shard"] for k, r in got.items()} == brute(sizes, limit)
        assert all(r["depth"] == len(r["shard"]) and not r["oversized"] for r in got.values())
        assert directory(shards(docs, limit)).filter(f"n_bytes > {limit}").count() == 0


def test_equal_keys_and_large_rows(spark):
    docs = documents(spark, ["x" * 100] * 40 + ["y" * 900] * 2 + ["z", None], ids=[7] * 40 + [1, None, None, 2])
    rows = shards(docs, 250).collect()
    held = defaultdict(int)
    for r in rows:
        held[r["shard"]] += r["n_bytes"]
    large = {r["shard"] for r in rows if r["oversized"]}
    assert len(rows) == 44 and len(large) == 2 and all(n <= 250 for s, n in held.items() if s not in large)
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) >= 16
    assert shards(docs.limit(0), 10).count() == 0


def test_files(spark, tmp_path):
    docs = documents(spark, [prose(20, i) for i in range(60)])
    table = write_shards(docs, str(tmp_path / "out"), 1500)
    back = spark.read.parquet(str(tmp_path / "out"))
    names = {f"b{r['shard']}": r["rows"] for r in table.collect()}
    assert len(names) == table.count() > 4
    assert {r["_shard"]: r["count"] for r in back.groupBy("_shard").count().collect()} == names
    for name, rows in names.items():  # each folder by itself
        assert spark.read.parquet(str(tmp_path / "out" / f"_shard={name}")).count() == rows
    one = write_shards(docs.limit(2), str(tmp_path / "one"), 10**6)
    assert [r["shard"] for r in one.collect()] == [""] and spark.read.parquet(str(tmp_path / "one")).first()["_shard"] == "b"
