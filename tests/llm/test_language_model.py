import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import ODD, documents, prose
from pyspark.sql import functions as F

import tributary.llm.language_model as module
from tributary.llm.language_model import CLASS_BITS, END, MEMBER_BITS, MEMBERS, OUTCOMES, OWN, STEP, Learner, fresh, hashed_words, scored, token_scores, trained

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ("held_out", "n", "row", "word", "score", "share")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def learned(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 != 0


def run(docs, **named):
    tenth = F.crc32(F.col("doc_id").cast("string")) % 10
    return scored(docs, learn=tenth != 0, held_out=tenth == 0, **named)


def base(rows):
    counts = Counter()
    for doc, text in rows:
        if learned(doc):
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        mine = tokens(text)
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in mine)
        out.append((doc, doc is not None and not learned(doc), len(mine), sum(counts[w] > 0 for w in mine), total, score))
    return out


def check_base(docs, rows):
    got = run(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    got = sorted((tuple(r)[:6] for r in got), key=key)
    for g, w in zip(got, sorted(base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    return got


@pytest.mark.parametrize("common", [4, 1 << 18])
def test_base_scores(spark, monkeypatch, common):
    """Also where most words' counts have to be joined."""
    monkeypatch.setattr(module, "COMMON", common)
    texts = [*ODD, *(prose(5 + i % 60, i % 20).upper() if i % 3 else prose(30, i) for i in range(60)), "É é ABC abc", "rare " * 3000]
    ids = [None, *range(1, len(texts))]
    check_base(documents(spark, texts, ids, clash=CLASH).repartition(3), list(zip(ids, texts, strict=True)))


def test_repeated_rows_no_training_rows_and_no_rows(spark):
    rows = [(3, "a b c"), (3, "a b c"), (None, None), (4, "")]
    check_base(documents(spark, [t for _, t in rows], [d for d, _ in rows]), rows)
    held = next(d for d in range(100) if not learned(d))
    (only,) = run(documents(spark, ["a b"], [held])).collect()
    assert (only["n_known"], only["train_tokens"], only["held_out"]) == (0, 0, True) and only["base_score"] == 0 and math.isfinite(only["score"])
    assert run(documents(spark, [])).count() == 0


def plain_rows(bits, kind, *parts):
    mixed, mask = kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1, (1 << 64) - 1
    for p in parts:
        mixed = (mixed ^ p) * 0xD6E8FEB86659FD93 & mask
        mixed ^= mixed >> 32
    return mixed >> (64 - bits)


def test_scores_against_plain_loops():
    rng = np.random.default_rng(1)
    vocab = type("V", (), {"mass": rng.random(OUTCOMES) + 0.1})
    w = fresh(vocab)
    w.classes[:] = rng.normal(size=w.classes.shape)
    w.members[:] = rng.normal(size=w.members.shape)
    texts = [rng.integers(0, OUTCOMES, n).tolist() for n in (1, 2, 3, 40, 1)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = token_scores(w, np.concatenate(texts).astype(np.uint16), starts)
    want = []
    for text in texts:
        for i, now in enumerate(text):
            one, two = (text[i - k] if i >= k else OUTCOMES for k in (1, 2))
            k, m = divmod(now, MEMBERS)
            x = w.class_bias.astype(float).copy()
            for row in (plain_rows(CLASS_BITS, 1, one), plain_rows(CLASS_BITS, 2, two, one), plain_rows(CLASS_BITS, 3, two)):
                x += w.classes[row]
            y = w.member_bias[k].astype(float) + w.members[plain_rows(MEMBER_BITS, 5, one, k)]
            want.append((x[k] - math.log(sum(map(math.exp, x))) + y[m] - math.log(sum(map(math.exp, y)))) / math.log(10))
    assert got == pytest.approx(want, abs=1e-4)


def test_chances_add_up_to_one():
    rng = np.random.default_rng(2)
    w = fresh(type("V", (), {"mass": rng.random(OUTCOMES) + 0.1}))
    w.classes[:], w.members[:] = rng.normal(size=w.classes.shape), rng.normal(size=w.members.shape)
    every = np.stack([np.full(OUTCOMES, 7), np.full(OUTCOMES, 9), np.arange(OUTCOMES)], axis=1).astype(np.uint16)
    last = token_scores(w, every.ravel(), np.arange(OUTCOMES + 1) * 3)[2::3]
    assert (10**last).sum() == pytest.approx(1, abs=1e-3)


def test_steps_learn_what_follows():
    w = fresh(type("V", (), {"mass": np.ones(OUTCOMES)}))
    learner = Learner(w)
    chain = np.tile(np.array([5, 700, 41], np.uint16), STEP)
    for _ in range(3):
        learner.learn(chain, np.array([0, len(chain)]))
    before, after = (token_scores(x, chain[:600], np.array([0, 600])).mean() for x in (w, learner.now))
    assert before == pytest.approx(-math.log10(OUTCOMES), abs=1e-3) and after > -0.5


def test_rounds_of_several_tasks_lift_held_out_scores(spark):
    """Text in which the word before says much about the next one."""
    rng = random.Random(4)
    names = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(1500):
        at, made = rng.randrange(300), []
        for _ in range(60):
            made.append(names[at])
            at = (at * 7 + rng.randrange(3)) % 300
        texts.append(" ".join(made))
    got = run(documents(spark, texts).repartition(4)).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.3


def test_shares_of_words_and_end(spark):
    """What all known words of an outcome and one unseen word share adds up to one."""
    texts = [prose(400, i) for i in range(40)]
    docs = documents(spark, texts)
    counted = docs.mapInArrow(module._count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocab = module.vocabulary(counted)
    names, codes, _ = hashed_words(pa.array(texts))
    n = Counter(codes.tolist())
    held = Counter()
    outcome, found = vocab.look_up(names)
    for i in range(len(names)):
        assert found[i] == n[i]
        held[int(outcome[i])] += n[i] + 0.1
    for o, total in held.items():
        assert vocab.mass[o] == pytest.approx(total + (0.1 if o >= OWN else 0))
    assert vocab.look_up(np.array([END]))[0][0] == 0 and vocab.tokens == len(codes) + 40
    assert callable(trained)
