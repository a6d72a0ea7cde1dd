import json

import pytest

from tributary.functions.text import client_of, snapshot_key
from tributary.schemas import EDGES, NODES
from tributary.sources import corpus, export, snapshots


def test_urls(spark):
    urls = [
        ("https://github.com/owner/repo", True, "owner", "repo"),
        (" http://www.github.com/owner/repo.git/ ", True, "owner", "repo"),
        ("github.com/o/r//", True, "o", "r"),
        ("https://gitlab.com/owner/repo", False, None, None),
        ("https://github.com/owner", False, None, None),
        ("https://github.com/a/b/c", False, None, None),
        ("not a url", False, None, None),
        (None, False, None, None),
    ]
    got = corpus.parse_repo_urls(spark.createDataFrame([(u[0],) for u in urls], "url string")).collect()
    assert [(r.url, r.valid, r.owner, r.name) for r in got] == urls
    loose = corpus.repo_path(spark.createDataFrame([("see github.com/a/b.git?x",), ("https://github.com/a/b/tree/c",), ("none",)], "url string"))
    assert [r.repo_path for r in loose.collect()] == ["a/b", "a/b", None]


def test_listing(spark):
    rows = [
        ("blob", "src/a.py", 10), ("tree", "src/b.py", 10), ("blob", "src/__init__.py", 1), ("blob", "src/a.txt", 1),
        ("blob", "latest.py", 5), ("blob", "big.py", 100_001), ("blob", "edge.py", 100_000), ("blob", "tests/x.py", 1),
        ("blob", "node_modules/x.py", 1), ("blob", "setup.py", 1), ("blob", "nosize.py", None),
    ]
    tree = spark.createDataFrame(rows, "type string, path string, size int")
    assert {r.path for r in corpus.list_sources(tree).collect()} == {"src/a.py", "edge.py", "nosize.py", "big.py"}
    limited = corpus.list_sources(tree, max_bytes=100_000)
    assert {r.path for r in limited.collect()} == {"src/a.py", "edge.py", "nosize.py"}
    limited = corpus.list_sources(tree, match="segment", max_bytes=100_000)
    assert {r.path for r in limited.collect()} == {"src/a.py", "edge.py", "nosize.py", "latest.py"}


def test_limit(spark):
    rows = [("big", "c", f"f{i}.py") for i in range(61)] + [("ok", "c", f"f{i}.py") for i in range(60)]
    tree = spark.createDataFrame(rows, "repo string, commit_sha string, path string")
    kept = corpus.within_limit(tree, 60)
    assert {r.repo for r in kept.collect()} == {"ok"} and kept.count() == 60
    assert [(r.repo, r.files) for r in corpus.over_limit(tree, 60).collect()] == [("big", 61)]
    assert corpus.within_limit(tree).count() == 121


def test_read_tree_whose_root_name_comes_again(spark, tmp_path):
    root = tmp_path / "src"
    for path in ("own/rep/c1/src/b.py", "own/rep/c1/a.py", "own/high.py"):
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x = 1")
    for given in (str(root), f"file://{root}/", f"file:{root}"):
        assert {(r.repo, r.commit_sha, r.path) for r in corpus.read_tree(spark, given).collect()} == {("own/rep", "c1", "src/b.py"), ("own/rep", "c1", "a.py")}
        assert [r.path.rsplit("/", 1)[-1] for r in corpus.misplaced(spark, given).collect()] == ["high.py"]


def test_read_tree(spark, tmp_path):
    for repo, path, data in [("o/r", "a.py", b"x = 1\n"), ("o/r", "pkg/b.py", b"y = '\xff'\n"), ("o/r", "c.txt", b"no")]:
        f = tmp_path / repo / "sha1" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    tree = corpus.read_tree(spark, str(tmp_path))
    assert {(r.repo, r.commit_sha, r.path, r["size"]) for r in tree.collect()} == {
        ("o/r", "sha1", "a.py", 6), ("o/r", "sha1", "pkg/b.py", 8)
    }
    files = {r.path: r.content for r in corpus.load_contents(corpus.list_sources(tree)).collect()}
    assert files["a.py"] == "x = 1\n" and files["pkg/b.py"] == "y = '\ufffd'\n"
    wanted = spark.createDataFrame([("o/r", "sha1", "a.py"), ("o/r", "sha1", "zz.py")], "repo string, commit_sha string, path string")
    got = {r.path: r.found for r in corpus.file_sources(corpus.load_contents(tree), wanted).collect()}
    assert got == {"a.py": True, "zz.py": False}


def test_snapshot_key(spark):
    from pyspark.sql import functions as F

    cases = [("my.org/some+repo!", "sha@1", "my_org__some_repo___sha_1.json"), ("Owner/Repo", "AbC-1_2", "owner__repo__AbC-1_2.json")]
    df = spark.createDataFrame(cases, "r string, s string, k string")
    assert all(r.ok for r in df.select((snapshot_key(F.col("r"), F.col("s")) == F.col("k")).alias("ok")).collect())


def test_client(spark):
    from pyspark.sql import functions as F

    rows = [("1.1.1.1, 2.2.2.2", "p", "1.1.1.1"), (" 3.3.3.3 ", None, "3.3.3.3"), ("", "p", "p"), (None, "p", "p"), (None, None, "unknown")]
    df = spark.createDataFrame(rows, "f string, p string, want string")
    assert all(r.ok for r in df.select((client_of(F.col("f"), F.col("p")) == F.col("want")).alias("ok")).collect())


def graph(spark, repo, sha, n):
    nodes = spark.createDataFrame([(repo, sha, f"n{i}", f"n{i}", "file", f"n{i}", "", None, None) for i in range(n)], NODES)
    edges = spark.createDataFrame([(repo, sha, "n0", f"n{i}", "imports") for i in range(1, n)], EDGES)
    return nodes, edges


def test_snapshot_store(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.read("o/r", "s1")[0].count() == 0 and not store.exists("o/r", "s1")
    stats = snapshots.stats(store.catalog()).first()
    assert (stats.total_entries, stats.total_size_kb, stats.oldest_entry) == (0, 0.0, None)
    a, b = graph(spark, "O/R", "s1", 3), graph(spark, "o/other", "s1", 2)
    store.write(a[0].unionByName(b[0]), a[1].unionByName(b[1]))
    store.write(*graph(spark, "O/R", "s1", 5))  # replaces one key only
    store.write(*graph(spark, "O/R", "s2", 4))
    nodes, edges = store.read("o/r", "s1")
    assert nodes.count() == 5 and edges.count() == 4
    assert store.read("o/other", "s1")[0].count() == 2
    assert store.exists("o/R", "s2") and not store.exists("o/r", "s9")
    assert [r.commit_sha for r in store.find("o/r").collect()] == ["s2", "s1"]
    assert {(r.repo, r.commit_sha) for r in snapshots.latest(store.catalog()).collect()} == {("O/R", "s2"), ("o/other", "s1")}
    keys = spark.createDataFrame([("o/r", "s1"), ("o/r", "s3")], "repo string, commit_sha string")
    assert [r.commit_sha for r in store.missing(keys).collect()] == ["s3"]
    assert snapshots.stats(store.catalog()).first().total_entries == 3
    assert store.invalidate("o/R", "s1") == 1 and store.invalidate("o/r", "s1") == 0
    assert store.read("o/r", "s1")[0].count() == 0 and store.read("o/r", "s2")[0].count() == 4
    store.write(*graph(spark, "O/R", "s1", 2))  # comes back after removal
    assert store.read("o/r", "s1")[0].count() == 2
    assert store.invalidate("o/r") == 2 and store.find("o/r").count() == 0


def test_unfinished_write_is_invisible(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    store.write(*graph(spark, "o/r", "s1", 3))
    from pyspark.sql import functions as F

    nodes, _ = graph(spark, "o/r", "s1", 9)
    late = nodes.withColumns({"repo_key": F.lit("o__r"), "write_id": F.lit("zzz")})
    late.write.mode("append").partitionBy("write_id").parquet(str(tmp_path / "store" / "nodes"))
    assert store.read("o/r", "s1")[0].count() == 3


def test_json_documents(spark, tmp_path):
    good = {"repo": "o/r", "commit_sha": "s", "nodes": [{"id": "a", "label": "a", "type": "file", "file": "a", "summary": "", "lines": []}, {"id": "a::f", "label": "f", "type": "function", "file": "a", "summary": "", "lines": [1, 9]}], "edges": [{"source": "a", "target": "a::f", "type": "defines"}]}
    bad = {"none.json": "{not json", "empty.json": "", "no_nodes.json": json.dumps({"edges": []}), "no_edges.json": json.dumps({"nodes": []})}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "bare.json").write_text(json.dumps({"repo": "x", "commit_sha": "y", "nodes": [], "edges": []}))
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    docs = snapshots.read_documents(spark, str(tmp_path) + "/*.json")
    valid = {r.file.split("/")[-1]: r.valid for r in docs.collect()}
    assert valid.pop("good.json") and valid.pop("bare.json") and not any(valid.values())
    nodes = {r.id: (r.start_line, r.end_line) for r in snapshots.document_nodes(docs).collect()}
    assert nodes == {"a": (None, None), "a::f": (1, 9)}
    assert snapshots.document_edges(docs).count() == 1


def test_conversation_export(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello\nyou"), (1, 2, "user", "Bye"), (2, 0, "user", "Solo")], "conv_id long, turn long, role string, text string")
    blocks = export.conversation_blocks(turns)
    text = "".join(r.block for r in blocks.filter("conv_id = 1").orderBy("turn").collect())
    assert text == "[USER]\nHi\n\n---\n\n[ASSISTANT]\nHello\nyou\n\n---\n\n[USER]\nBye"
    out = str(tmp_path / "out")
    export.write_conversations(blocks, out)
    written = "".join(p.read_text() for p in sorted((tmp_path / "out" / "conv_id=1").glob("part-*")))
    assert written == text + "\n"


def test_shared_dir_needs_a_setting_on_clusters(spark):
    from tributary.session import shared_dir

    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
