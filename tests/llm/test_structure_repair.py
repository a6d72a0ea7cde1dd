import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from llm_fixtures import ODD

from tributary.llm.queries import damaged
from tributary.llm.structure_repair import EDGES, FAULTS, LETTERS, ROLES, repairs, search, solved

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, block string, at string, audit string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def least(rows):
    """The least (cost, audit) and its output by dynamic programming, with up to three inserts anywhere."""

    def grown(best):
        for _ in range(3):
            new = dict(best)
            for q, (c, a, out) in best.items():
                for r in "ua":
                    if r in NEXT[q]:
                        way = (c + 2, a + "I", (*out, (NAMES[r], "")))
                        if r not in new or way[:2] < new[r][:2]:
                            new[r] = way
            best = new
        return best

    best = {"": (0, "", ())}
    for role, text, fault in rows:
        new = {}

        def put(q, way, new=new):
            if q not in new or way[:2] < new[q][:2]:
                new[q] = way

        for q, (c, a, out) in grown(best).items():
            put(q, (c + 3, a + "D", out))
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                if role[:1] and role[:1] in NEXT[q]:
                    put(role[:1], (c, a + "K", (*out, (role, text))))
                for r in "ua":
                    if r in NEXT[q]:
                        put(r, (c + 2, a + "R", (*out, (NAMES[r], text))))
        best = new
    best = grown(best)
    return min((best[q] for q in best if q in ("", "a")), key=lambda way: way[:2])


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = text.strip(WHITE)
        out.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "none"))
        seen.add((role, text))
    return out


def judged(conv, rows):
    """``rows``: (turn, role, text) without nulls but in turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults([r[1:] for r in rows])
    n = Counter(f for _, _, f in found)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = least(found)
    return (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


def broken(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out[conv] += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def check(spark, rows):
    from pyspark.sql import functions as F

    import tributary.llm.queries as queries

    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    kept, queries.table = queries.table, lambda *_: frame
    try:
        got = queries.op12_structure_repair(spark, "").collect()
    finally:
        queries.table = kept
    made = broken(rows)
    want = [judged(conv, made[conv])[0] for conv in {r[0] for r in rows}]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    turns = repairs(damaged(frame)).turns().groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "sub", "role", "text"))).alias("t")).collect()
    for r in turns:
        assert [(t["role"], t["text"]) for t in r["t"]] == list(judged(r["conv_id"], made[r["conv_id"]])[1])


def test_search_against_dynamic_programming():
    rng = random.Random(3)
    kinds = {"s": "none", "d": "blank", "t": "truncated"}
    for n in [*range(9)] * 60 + [40, 64]:
        letters = "".join(rng.choice(LETTERS) for _ in range(n))
        rows = [(ROLES[LETTERS.index(c) // 3], str(i), kinds[FAULTS[LETTERS.index(c) % 3]]) for i, c in enumerate(letters)]
        assert solved(letters) == least(rows)[:2], letters
    for q in range(4):  # an entry state that cannot lead to an end has no way
        assert (search([EDGES["A"]], q, (1,)) is None) == (q > 1)


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["Yes.", "no", "Why? ", "", " \n", None, "End!\t", "cut,", "a.b", *ODD]
    roles = ["user", "assistant", "system", "User", "", None, "tool", "ua", "s"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles[: 3 + c % 7]), rng.choice(texts)) for c in range(120) for t in rng.sample(range(9), rng.randint(1, 7))]
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", "none."), (-3, -2, "user", "minus."), (500, 0, "user", "x" * 200_000)]
    check(spark, rows + rows[:50])


def test_long_conversations(spark):
    """Blocks, and blocks of blocks, give what one search gives."""
    rng = random.Random(4)
    rows = [(9, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(5000)]
    rows += [(10, 0, "system", "start.")] + [(10, t, "user", "") for t in range(1, 200)]
    rows += [(11, 1, "user", "same.")] * 300
    check(spark, rows)


def test_conversation_that_loses_all_rows_and_empty_table(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(lost, 0, "user", "gone."), (lost + 1, 7, "user", "here.")])
    none = repairs(spark.createDataFrame([], SCHEMA))
    assert none.summary.count() == 0 and none.turns().count() == 0
