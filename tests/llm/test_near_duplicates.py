import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import ODD, documents, prose

from tributary.llm import near_duplicates as nd
from tributary.llm.near_duplicates import components, far_bits, near_duplicates, shingle_sets, signatures


def sets(texts, k):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(texts, ids, k, percent=80):
    """Components by comparing every pair."""
    have, root = sets(texts, k), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if have[i] and have[j] and ids[i] is not None and ids[j] is not None:
                both = len(have[i] & have[j])
                if 100 * both >= percent * (len(have[i]) + len(have[j]) - both):
                    root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(have[i]), least[top(i)] if d is not None else None) for i, d in enumerate(ids)]


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 99999)}" for w in text.split(" "))


@pytest.mark.parametrize(("k", "blocks"), [(2, 1_000_000), (5, 400)])
def test_against_brute_force(spark, monkeypatch, k, blocks):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", blocks)
    base, family = prose(120, 1), prose(150, 2)
    texts = [
        *ODD, base, base, base.upper(), base + " tail", *(changed(base, 0.03, s) for s in range(12)), *(changed(family, 0.06, s) for s in range(40)),
        "that it.", "That  it.", "that is.", prose(200, 9), "a b c d", "a b c d e", "go go go go go go",
    ]
    rng = random.Random(3)
    ids = rng.sample(range(-50, 1000), len(texts))
    docs = documents(spark, texts, ids=ids, clash=("node", "bands", "n", "key")).repartition(3)
    got = sorted(map(tuple, near_duplicates(docs, k=k).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert got == sorted((d, n, c, d == c) for d, n, c in brute(texts, ids, k))


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [prose(30, 1)] * 4 + [None], ids=[5, 5, None, 9, 7])
    got = sorted(map(tuple, near_duplicates(docs, k=2).collect()), key=str)
    assert got == sorted([(5, 29, 5, True), (5, 29, 5, True), (None, 29, None, True), (9, 29, 5, False), (7, 0, 7, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 199)]
    frame = spark.createDataFrame([(a.to_bytes(2), b.to_bytes(2)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r["node"]): int.from_bytes(r["component"]) for r in components(frame).frame.collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 200: 199, 199: 199}


def test_sketches_estimate_high_similarities():
    import pyarrow as pa

    base = prose(2000, 1)
    value, starts = shingle_sets(pa.array([base, changed(base, 0.02, 1), changed(base, 0.3, 2)]), 5)
    keys, sketch = signatures(value, starts, nd.BANDS, nd.ROWS)
    have = sets([base, changed(base, 0.02, 1), changed(base, 0.3, 2)], 5)
    apart = [int(np.bitwise_count((sketch[0] ^ s).view(np.uint64)).sum()) for s in sketch[1:]]
    alike = [len(have[0] & h) / len(have[0] | h) for h in have[1:]]
    assert alike[0] >= 0.8 and apart[0] <= far_bits(0.8 - nd.MARGIN, nd.BANDS * nd.ROWS) and (keys[0] == keys[1]).any()
    assert alike[1] < 0.3 and apart[1] > far_bits(0.8 - nd.MARGIN, nd.BANDS * nd.ROWS)


def test_blocks_put_out_no_more_rows_than_they_take():
    """A bucket of classes that are all near each other, each a component of its own."""
    n, shared = 60, list(range(70))
    names = [b"%03d" % i for i in range(n)]
    both = [(name, asks) for name in names for asks in (True, False)]
    columns = {"key": [7] * len(both), "node": [a for a, _ in both], "n": [100] * len(both), "asks": [asks for _, asks in both]}
    sketch = {f"s{i}": pa.array([0] * len(both), pa.int64()) for i in range(8)}
    out = nd._asked(80, 200)(pa.table({**columns, "component": columns["node"], **sketch}))
    assert out.num_rows == len(both)
    for percent, want in ((80, 0), (50, n - 1)):  # 70 of 130 shingles are common to each two
        lists = pa.array([shared + [1000 * int(a) + i for i in range(100, 130)] for a, _ in both], pa.list_(pa.int64()))
        links = nd._linked(percent, 200)(pa.table({**columns, "own": columns["node"], "shingles": lists, **sketch})).to_pylist()
        assert len(links) == want
        reached = {names[0]}
        for _ in links:
            reached |= {x for r in links if r["a"] in reached or r["b"] in reached for x in r.values()}
        assert len(reached) == (n if want else 1)
