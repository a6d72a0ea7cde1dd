import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from llm_fixtures import ODD

from tributary.llm.prefix_trie import digests, prefix_trie, subtree_sums
from tributary.llm.queries import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, `id` string, `depth` string, `part` string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(turns)] for conv, turns in own.items()}
    made = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rest = conv % 20 if conv >= 0 else -(-conv % 20)
        made[conv] = own.get(conv - rest, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for conv, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members) - 1) * words
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(m) for m in sorted(members) if len(made[m]) == len(path))
        above = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), above, len(members), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = sorted(map(tuple, prefix_trie(*rebuilt(frame)).collect()), key=lambda r: r[:2])
    assert got == brute(rows)
    return got


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "d. e f", None, ""])) for c in range(70) for t in range(rng.randint(1, 6))]
    rows += [(c, None, "system", "first") for c in (3, 20, 41)] + [(None, 1, "user", "no id"), (-5, 0, "user", "a b"), (-20, 0, "user", "x y"), (-21, 0, "user", "z")]
    rows += [(200 + i, i % 2, "user", t) for i, t in enumerate(ODD)]
    rows += rows[:40]
    check(spark, rows)


def test_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000, 20) for t in range(3)]
    rows += [(7, t, "user", f"turn {t} of many") for t in range(2500)]
    got = check(spark, rows)
    assert max(r[3] for r in got) == 151 and max(r[1] for r in got) >= 2497


def test_turnless_conversations_end_at_the_root(spark):
    short = [c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4][:5]
    got = check(spark, [(c, 0, "user", "only") for c in short])
    assert got[0][1] == 0 and got[0][3] == 5 and got[0][4] == 0


def test_empty_table(spark):
    assert prefix_trie(*rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_sums_of_trees(spark):
    """Chains, stars, and random trees, against sums along every path to the root."""
    rng = random.Random(2)
    parents = {0: None, **{i: i - 1 for i in range(1, 600)}, **{i: 300 for i in range(600, 900)}, 5000: None}
    parents |= {i: rng.choice([i - 1, rng.randrange(900, i)]) if i > 900 else 899 for i in range(900, 1500)}
    name, want, depth = lambda i: str(i).encode(), Counter(), {}
    for i in sorted(parents):
        depth[i] = 0 if parents[i] is None else depth[parents[i]] + 1
        at = i
        while at is not None:
            want[name(at)] += i
            at = parents[at]
    rows = [(name(i), None if p is None else name(p), depth[i], i, 1) for i, p in parents.items()]
    found = subtree_sums(spark.createDataFrame(rows, "id binary, parent binary, depth long, v long, n long"), ["v", "n"])
    got = {bytes(r["id"]): (r["v"], r["n"]) for r in found.frame.collect()}
    assert {k: v for k, (v, _) in got.items()} == dict(want) and got[name(0)][1] == len(parents) - 1


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    import tributary.llm.prefix_trie as module

    seen, plain = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df, label: seen.append(label) or plain(df, label))
    rows = [(str(i).encode(), str(i - 1).encode() if i else None, i, 1) for i in range(1000)]
    found = subtree_sums(spark.createDataFrame(rows, "id binary, parent binary, depth long, n long"), ["n"]).frame
    assert found.filter("id = cast('0' as binary)").first()["n"] == 1000 and seen.count("marked") <= 13


def test_digests_join_batches(spark):
    ends = spark.range(25_000).selectExpr("cast('n' as binary) as id", "id - 9 as conv_id").repartition(7)
    got = digests(ends).collect()
    assert len(got) == 1 and got[0]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(-9, 24_991))).encode()).hexdigest()
