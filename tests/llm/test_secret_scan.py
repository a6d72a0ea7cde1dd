import random
import re
import string
import time

from llm_fixtures import ODD, documents, prose
from pyspark.sql import functions as F

from tributary.llm.secret_scan import ALPHABET, SHORTEST, THRESHOLD, listed, of_kind, ratios, redacted, samples_of, transitions, with_spans

RULE = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in RULE.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def key(n, seed, letters=string.ascii_letters + string.digits):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


TEXTS = [
    *ODD, 'Token = "' + key(40, 1, "0123456789abcdef") + '" é', "AKIA" + key(16, 2, string.ascii_uppercase + string.digits) + " AKIA123", "🙂 PASSWORD:hunter2 passwd='longer.secret=value'",
    "api_key=short api-key=abcdefghijk APIKEY: abcdefgh12 secret=secret=abcdefgh", key(31, 3, "0123456789abcdef"), "x" + key(70, 4, "0123456789abcdef") + "y",
    "AKIA" * 5, "password=\npassword= 12345678", prose(100, 5),
]


def test_base_spans_against_brute_force(spark):
    docs = documents(spark, TEXTS, clash=("spans", "hit", "gap"))
    rows = with_spans(docs, [0.0] * 67 * 67).select("doc_id", "hit", listed(of_kind(F.col("spans"), "assign", "access", "hex")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS)} and {r["hit"] for r in rows} == {"other"}


def test_models_find_keys_without_a_rule(spark):
    train = documents(spark, [f"{prose(80, i)} token={key(40, i)} {prose(9, i + 500)}" for i in range(150)] + [None, ""])
    table = ratios(transitions(samples_of(train)))
    assert table == ratios(transitions(samples_of(train.repartition(5))))
    words = ["internationalization", "counterrevolutionaries", "abcdefghijklmnop" * 2, "pneumonoultramicroscopic"]
    texts = [f"use {key(40, 900 + i)} now" for i in range(20)] + [f"see {w} here" for w in words] + ["password=" + key(30, 7)]
    got = {r["doc_id"]: r["s"] for r in with_spans(documents(spark, texts), table).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert sum(got[i] == "markov:4:44" for i in range(20)) >= 16
    assert all(got[20 + i] == "" for i in range(len(words)) if i != 2) and got[24] == "assign:0:39"


def test_keys_inside_longer_runs(spark):
    train = documents(spark, [f"{prose(80, i)} {prose(40, i + 700).replace(' ', '/')} token={key(40, i)} {prose(9, i + 500)}" for i in range(150)])
    table = ratios(transitions(samples_of(train)))
    path, access, long_hex = "abcde/" * 40, "AKIA" + key(16, 2, string.ascii_uppercase + string.digits), key(32, 3, "0123456789abcdef")
    texts, wanted = [], []
    for i in range(10):
        one, two = key(40, 950 + i), key(40, 990 + i)
        texts += [f"é {path}{one} x", f"{path}{one}/{path}{two}/{path}", f"{access}={one}", f"{long_hex}/{one}", path]
        wanted += [[one], [one, two], [one], [one], []]
    rows = with_spans(documents(spark, texts, clash=("_rest",)), table).select("doc_id", "text", "_rest", of_kind(F.col("spans"), "markov").alias("s")).collect()
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["s"]] for r in rows}
    assert all(r["_rest"] == "other" for r in rows)
    # A span may take in the path segments beside its key.
    assert all(len(got[i]) == len(w) and all(k in g and len(g) <= len(k) + 14 for k, g in zip(w, got[i])) for i, w in enumerate(wanted)), got


def plain_stretches(text, table):
    """The models' spans by plain loops: runs of key characters, a running sum, and the separators around a stretch."""
    n, out = len(ALPHABET), []
    for m in re.finditer("[A-Za-z0-9+/_=-]{%d,}" % SHORTEST, text):
        run, found = m[0], []
        total = best = 0.0
        start = stop = 0
        for i in range(1, len(run) + 1):
            after = total + table[ALPHABET.index(run[i - 1]) * n + ALPHABET.index(run[i])] if i < len(run) else None
            if after is None or after <= 0 or best - after >= THRESHOLD:
                if best >= THRESHOLD:
                    found.append((start, stop))
                total, best, start = 0.0, 0.0, i
            else:
                total = after
                if total > best:
                    best, stop = total, i + 1
        spans = set()
        for a, b in found:
            while a > 0 and run[a - 1] not in "/=_-":
                a -= 1
            while b < len(run) and run[b] not in "/=_-":
                b += 1
            while b < len(run) and run[b] == "=":
                b += 1
            if b - a >= SHORTEST:
                spans.add((m.start() + a, m.start() + b))
        out += sorted(spans)
    return ",".join(f"markov:{a}:{b}" for a, b in out)


def test_models_against_plain_scorer(spark):
    train = documents(spark, [f"{prose(80, i)} {prose(40, i + 700).replace(' ', '/')} token={key(40, i)} {prose(9, i + 500)}" for i in range(150)])
    table = ratios(transitions(samples_of(train)))
    rng = random.Random(8)
    texts = []
    for i in range(60):
        parts = [rng.choice([key(rng.randrange(10, 60), rng.random()), prose(4, i).replace(" ", rng.choice("/_-=")), "==", "é ", "🙂", " "]) for _ in range(12)]
        texts.append(rng.choice(["", "/", "_"]).join(parts))
    texts = [t for t in texts if not brute(t)]
    rows = with_spans(documents(spark, texts), table).select("doc_id", listed(F.col("spans")).alias("s")).collect()
    assert len(texts) > 30 and sum(bool(r["s"]) for r in rows) > 20
    assert {r["doc_id"]: r["s"] for r in rows} == {i: plain_stretches(t, table) for i, t in enumerate(texts)}


def test_many_matches_in_one_text(spark):
    """20,000 assignments in one text: places, blanks and redaction grow with them, not with their square."""
    text = "é".join(f"token={i:09d} abcde" for i in range(20000))
    docs = documents(spark, [text])
    with_spans(docs.limit(0), [0.0] * 67 * 67).collect()
    begun = time.monotonic()
    row = redacted(with_spans(docs, [0.0] * 67 * 67), F.lit("[S]")).select("text", listed(F.col("spans")).alias("s")).first()
    spent = time.monotonic() - begun
    assert row["s"] == brute(text) and row["text"] == "é".join(["[S] abcde"] * 20000)
    assert spent < 15, spent


def test_redaction(spark):
    docs = with_spans(documents(spark, TEXTS), [0.0] * 67 * 67)
    got = {r["doc_id"]: r["text"] for r in redacted(docs, F.lit("[S]")).collect()}
    assert got[0] is None and got[1] == "" and got[len(ODD)] == "[S]\" é"
    assert got[len(ODD) + 2] == "🙂 PASSWORD:hunter2 [S]'" and got[len(ODD) + 8] == TEXTS[-1]


def test_no_samples_and_empty_table(spark):
    docs = documents(spark, [None, ""])
    table = ratios(transitions(samples_of(docs)))
    assert set(table) == {0.0} and with_spans(docs.limit(0), table).count() == 0


def test_plan_names_the_table_of_ratios_once(spark):
    """The driver keeps the text of plans; the table has thousands of numbers."""
    table = [i / 7 for i in range(len(ALPHABET) ** 2)]
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = with_spans(docs, table)._jdf.queryExecution().analyzed().toString()
    assert plan.count(f"{table[0]!r},{table[1]!r},{table[2]!r},") == 1
