import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import ODD, documents, prose

from tributary.llm import toxicity
from tributary.llm.queries import fold, op4_toxicity
from tributary.llm.toxicity import BUCKETS, Setting, Toxicity, fit, fitted, subwords, with_score

INSULTS = ["blockhead", "nitwit", "scoundrel", "dimwit"]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words, toxic = prose(rng.randint(3, 60), seed * 1000 + i).split(" "), i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_unseen_misspellings_share_ngrams():
    texts, labels = corpus(800, 1)
    model = fit(pa.array(texts), labels, prior=0.25)
    held, truth = corpus(200, 2)
    assert ((model(pa.array(held)) >= 0.5) == truth).mean() >= 0.97
    clean = prose(40, 77)
    scores = model(pa.array([clean, f"{clean} BLOCKHEADS!!", f"{clean} blockheadd", clean + " n.i.t.w.i.t"]))
    assert scores[0] < 0.5 and (scores[1:] >= 0.5).all()


def test_one_class_or_none():
    assert (fit(pa.array([], pa.string()), np.zeros(0))(pa.array(["a", None])) < 0.5).all()
    assert (fit(pa.array(["a b", "c"]), np.zeros(2))(pa.array(["a", ""])) < 0.5).all()
    assert (fit(pa.array(["a b", "c"]), np.ones(2))(pa.array(["a", None])) > 0.5).all()


def test_scores_of_odd_rows(spark):
    texts, labels = corpus(120, 3)
    docs = documents(spark, [*texts, *ODD, None], clash=("score", "label"))
    rows = [(i, int(t)) for i, t in enumerate(labels)] + [(None, 1), (3, None), (4, 7), (9999, 1), (5, int(labels[5]))]
    model = fitted(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in with_score(docs, model).collect()}
    assert len(got) == len(texts) + len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["label"] == "other" for r in got.values())
    assert with_score(docs.limit(0), model).count() == 0
    none = fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.5 for r in with_score(docs, none).collect())


def test_held_out_accuracy(spark):
    """On a fifth of the labels that the model never sees."""
    folder = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{folder}/labels.parquet").filter(fold() == 0)
    got = op4_toxicity(spark, folder).filter("held_out").join(truth, "doc_id").groupBy("toxic", "predicted").count().collect()
    table = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert table[0, 0] / (table[0, 0] + table.get((0, 1), 0)) >= 0.99
    assert table[1, 1] / (table[1, 1] + table.get((1, 0), 0)) >= 0.8


@pytest.mark.parametrize("window", [1, 2, 3])
def test_scores_equal_plain_loops(window):
    """Mean over n-grams, mean over a window's words, the worst window, the logistic function."""
    margins = np.random.default_rng(window).normal(0, 2, BUCKETS).astype(np.float32)
    model = Toxicity(margins, -0.3, window)

    def plain(text):
        each = []
        for word in (text or "").split():
            grams, _ = subwords(pa.array([word]))
            each.append(sum(float(margins[g]) for g in grams) / len(grams))
        if not each:
            return 1 / (1 + math.exp(0.3))
        ends = range(window, len(each) + 1) if len(each) >= window else [len(each)]
        worst = max(sum(each[max(e - window, 0) : e]) / min(window, len(each)) for e in ends)
        return 1 / (1 + math.exp(-(worst - 0.3)))

    texts = [prose(n, n) for n in (1, 2, 3, 7, 60)] + ["ünï cödé Wörter!", "... --", "", None]
    assert np.allclose(model(pa.array(texts)), [plain(t) for t in texts], rtol=1e-5)


def test_n_grams_by_plain_slices():
    grams, starts = subwords(pa.array(["Ab-c", "nitwit"]))
    assert np.diff(starts).tolist() == [1 + 3 + 2 + 1, 1 + 6 + 5 + 4 + 3]
    again, _ = subwords(pa.array(["abc"]))
    assert grams[: starts[1]].tolist() == again.tolist()


def test_the_setting_is_chosen_on_rows_held_back():
    """A lone word is found by windows of one word, whatever else is offered and in which order."""
    texts, labels = corpus(600, 5)
    model = fit(pa.array(texts), labels, prior=0.25, settings=(Setting(30, 20), Setting(1, 20)))
    assert model.window == 1


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    texts, labels = corpus(300, 6)
    texts[4] += " x" * 300_000
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, int(t)) for i, t in enumerate(labels)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FIT_BYTES", 40_000)
    got = with_score(docs, fitted(docs, marks)).collect()
    assert len(got) == 300 and all(0 <= r["score"] <= 1 for r in got)


def test_a_fit_holds_few_bytes_for_an_n_gram():
    rng = random.Random(3)
    texts = pa.array([" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(4, 9))) for _ in range(200)) for _ in range(600)])
    labels = np.arange(600) % 4 == 0
    n_grams = len(subwords(toxicity.words(texts).distinct)[0])
    tracemalloc.start()
    try:
        fit(texts, labels, epochs=6)
        assert tracemalloc.get_traced_memory()[1] < 46 * n_grams
    finally:
        tracemalloc.stop()


def test_documents_that_hold_an_n_gram_are_counted_in_runs_of_words(monkeypatch):
    texts = pa.array([prose(30, seed) for seed in range(20)] + [None, "", "tree tree trees"])
    found = toxicity.words(texts)
    grams, starts = subwords(found.distinct)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    want = np.zeros(BUCKETS)
    for a, b in zip(found.starts[:-1], found.starts[1:], strict=True):
        for word in set(found.codes[a:b].tolist()):
            np.add.at(want, grams[starts[word] : starts[word + 1]], 1)
    assert np.array_equal(toxicity._in_docs(grams, np.diff(starts), found), want)
