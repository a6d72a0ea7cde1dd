import re
from collections import Counter

import pytest
from llm_fixtures import ODD, documents, prose

from tributary.llm import substrings
from tributary.llm.substrings import drop_repeats


def brute(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("window", "shard_words", "slice_bytes"), [(35, 2_000_000, 4 << 20), (6, 300, 2000), (5, 50, 1), (2, 100, 500)])
def test_against_brute_force(spark, monkeypatch, window, shard_words, slice_bytes):
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard_words)
    shared, other = prose(80, 1), prose(36, 2)
    texts = [
        *ODD, prose(200, 3), f"{prose(17, 4)} {shared} {prose(9, 5)}", f"{shared}\n{other}", f"{prose(3, 6)}\t{other} {prose(50, 7)} {other}",
        shared, shared, "go " * 90, prose(300, 8) + " " + prose(300, 8), " ".join(shared.split()[:35]), " ".join(shared.split()[1:35]),
    ]
    docs = documents(spark, texts, clash=("slice", "rows", "n_words", "bits")).repartition(3)
    got = {r["doc_id"]: r for r in drop_repeats(docs, window, rejoin=True).collect()}
    for i, (n, gone, kept) in enumerate(brute(texts, window)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) == (n, gone, None if texts[i] is None else kept), i
        assert got[i]["slice"] == got[i]["rows"] == "other"


def test_untouched_texts_stay_as_they_are(spark):
    texts = ["a  b\tc", None, "", prose(40, 1) + "  x", prose(40, 1)]
    got = {r["doc_id"]: r["text"] for r in drop_repeats(documents(spark, texts), 35).collect()}
    assert got == {0: "a  b\tc", 1: None, 2: "", 3: "x", 4: ""}


def test_empty_table_and_null_ids(spark):
    docs = documents(spark, [prose(50, 1)] * 2, ids=[None, None])
    assert [r["n_removed"] for r in drop_repeats(docs).collect()] == [50, 50]
    assert drop_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        drop_repeats(docs, 1)
