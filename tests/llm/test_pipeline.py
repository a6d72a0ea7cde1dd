"""The stages one after another, each held against brute force on its own input."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import test_near_duplicates
import test_substrings
from llm_fixtures import prose
from pyspark.sql import functions as F
from test_packing import check, expected

INSULT = "blockhead"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    shared = prose(60, 1)
    texts = {i: prose(40 + i % 30, i + 10) for i in range(240)}
    for i in range(0, 240, 4):
        texts[i] = f"{INSULT} {texts[i]}"
    texts[301] = texts[302] = prose(90, 5)
    texts[303] = texts[301] + " more"
    texts[304], texts[305] = f"{prose(20, 6)} {shared} {prose(30, 7)}", f"{prose(25, 8)} {shared}"
    texts[306], texts[307], texts[308] = None, "", f"{prose(15, 9)} token = \"{'0123456789abcdef' * 3}\" {prose(5, 11)}"
    return texts


def test_stages(spark, tmp_path):
    texts = corpus()
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240) if zlib.crc32(str(i).encode()) % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            check(docs.collect(), dict(zip(before, expected(before.values()), strict=True)), 2048)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
        if name == "toxicity":
            gone = before.keys() - after.keys()
            assert len(gone & set(range(0, 240, 4))) >= 57 and len(gone - set(range(0, 240, 4))) <= 2
            assert all(after[i] == before[i] for i in after)
        elif name == "near_duplicates":
            ids = list(before)
            found = test_near_duplicates.brute([before[i] for i in ids], ids, 5)
            assert after == {i: before[i] for i, (_, _, c) in zip(ids, found, strict=True) if i == c}
            assert 301 in after and not {302, 303} & after.keys()
        elif name == "substring_dedup":
            for (i, text), (_, gone, left) in zip(before.items(), test_substrings.brute(before.values(), 35), strict=True):
                assert after[i] == (left if gone else text)
            assert prose(60, 1) not in after[304] and len(after[304].split()) == 50
        else:
            assert after[308].endswith(prose(5, 11)) and corpus_pipeline.SECRET in after[308] and not re.search("[0-9a-f]{32}", after[308])
            assert all(after[i] == before[i] for i in after if i != 308)
        kept[name] = len(after)
    assert Counter(kept).most_common()[-1][1] > 150


def test_clashing_names(spark, tmp_path):
    """Columns named as those that the operators make come back as they were."""
    names = ["score", "_score", "spans", "_toxic", "_spans", "n_words", "n_removed", "removed", "own_n_words", "kept", "group", "component_id", "text_key", "row", "copies", "slice"]
    passage = prose(60, 1)
    texts = [f"{prose(20, 2)} {passage}", f"{passage} {prose(50, 3)}", f"{prose(9, 4)} token = \"{'0123456789abcdef' * 3}\"", None, ""]
    rows = [(i, t, "en", "s", len(t or ""), *(f"{c}{i}" for c in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in names))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    changed = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = {r["doc_id"]: r for r in out.collect()}
        assert all(r[c] == f"{c}{i}" for i, r in got.items() for c in names) and len(got) == 5, name
        changed[name] = {i for i, r in got.items() if r["text"] != texts[i]}
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert changed == {"toxicity": set(), "near_duplicates": set(), "substring_dedup": {0, 1}, "secret_scan": {2}}


def test_run_gives_the_last_stage(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en", "s", 3), (None, None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # Without labels nothing is known to be toxic.
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 2


def test_near_copies_of_repeated_ids(spark, tmp_path):
    x, y, clean = prose(40, 1), prose(40, 2), prose(40, 3)
    texts = [
        (3, y), (5, x), (5, y), (8, x),  # each of the sets of 5 keeps its smallest row
        (8, clean),  # not linked, though its id goes elsewhere
        (20, prose(40, 4)), (20, prose(40, 4)), (21, prose(40, 4)),  # equal rows
        (30, prose(90, 5)), (30, prose(90, 5) + " more"),  # a near copy under the same id
        (40, prose(40, 6)), (40, prose(40, 7)),  # one id, nothing in common
        (50, None), (50, ""), (None, x), (None, x),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)
    out = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert out.schema.names == docs.schema.names
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    either = [(30, prose(90, 5)), (30, prose(90, 5) + " more")]
    assert sum(got.pop(e, 0) for e in either) == 1
    assert got == Counter([(3, y), (5, x), (8, clean), (20, prose(40, 4)), (40, prose(40, 6)), (40, prose(40, 7)), (50, None), (50, ""), (None, x), (None, x)])
    unique = docs.filter("doc_id in (3, 8) and text <> ''").dropDuplicates(["doc_id"])
    assert corpus_pipeline.near_copies(spark, unique, str(tmp_path)).count() == 2
