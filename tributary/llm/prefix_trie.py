"""Prefix tries of conversations, and subtree sums by parallel tree contraction.

A node is a distinct sequence of first turns.  Its id combines digests of
(depth, turn) by exclusive or, which is associative: prefixes of a long conversation are
formed per block of turns and carried over block totals, in many tasks.

Subtree sums come from contraction rounds.  Rake: every leaf hands its sum to its parent
and goes.  Compress: of neighbouring unary nodes in a chain one goes, and its child moves
up to its parent.  A tree of n nodes and any depth takes O(log n) rounds, each a
few joins on what is left.  Then the rounds are undone from the last to the first:
a compressed node's sum is what it held and the sum of the child that it had.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import Staged, staged
from tributary.llm.turns import runs

#: Turns whose prefixes are formed in one run.
BLOCK = 1024

#: Tasks over which the children of one parent spread.
SALTS = 64

ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def _node(x: str, y: str) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.col(c)), 16, F.lit("0")) for c in (x, y))))


def subtree_sums(tree: DataFrame, values: list[str]) -> Staged:
    """For each node of a forest, the sums of ``values`` over its subtree, itself included: ``id, *values``.

    ``tree`` holds ``id, parent`` (null for a root), ``depth``, any number that grows from parent to
    child, and ``values`` as longs.  Ids are unique and not null.  An empty tree gives no rows.
    """
    moved = [f"over_{v}" for v in values]  # what compressed nodes between a node and its parent hold
    state = staged(tree.select("id", "parent", "depth", *values, *(F.lit(0).cast("long").alias(m) for m in moved)), "tree")
    scrap, rounds = [state], []
    while True:
        now = state.frame.select("id", "parent", "depth", *values, *moved)
        kids = now.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("only"))
        marked = staged(now.join(kids, "id", "left"), "marked")
        scrap.append(marked)
        rows = marked.frame
        if rows.filter("parent is not null").isEmpty():
            break
        leaves = rows.filter("kids is null and parent is not null")
        chain = rows.filter("kids = 1 and parent is not null").select("id", "only", _turn().alias("turn"))
        above, below = (chain.select(*(F.col(c).alias(f"{side}_{c}") for c in chain.columns)) for side in ("a", "b"))
        later = above.join(below, F.col("a_only") == F.col("b_id")).select(F.when(F.col("a_turn") < F.col("b_turn"), F.col("b_id")).otherwise(F.col("a_id")).alias("id"))
        going = chain.join(later.distinct(), "id", "left_anti").join(leaves.select(F.col("id").alias("only")), "only", "left_anti")
        cut = staged(
            rows.join(going.select("id"), "id", "left_semi").select(
                F.col("only").alias("id"), F.col("id").alias("via"), F.col("parent").alias("up"),
                *(F.col(v).alias(f"via_{v}") for v in values), *(F.col(m).alias(f"via_{m}") for m in moved),
            ),
            "cut",
        )
        sums = leaves.groupBy(F.col("parent").alias("id")).agg(*(F.sum(F.col(v) + F.col(m)).alias(f"raked_{v}") for v, m in zip(values, moved, strict=True)))
        stay = rows.filter("kids is not null or parent is null").join(cut.frame.select(F.col("via").alias("id")), "id", "left_anti")
        after = stay.join(cut.frame, "id", "left").join(sums, "id", "left")
        zero = F.lit(0).cast("long")
        state = staged(
            after.select(
                "id", F.coalesce("up", "parent").alias("parent"), "depth", "via",
                *((F.col(v) + F.coalesce(f"raked_{v}", zero)).alias(v) for v in values),
                *((F.col(m) + F.coalesce(F.col(f"via_{v}") + F.col(f"via_{m}"), zero)).alias(m) for v, m in zip(values, moved, strict=True)),
                *((F.col(f"via_{v}") + F.col(m)).alias(f"add_{v}") for v, m in zip(values, moved, strict=True)),
            ),
            "tree",
        )
        scrap += [cut, state]
        rounds.append((leaves.select("id", *values), state.frame.filter("via is not null")))
    known = [marked.frame.select("id", *values)]
    for leaves, spliced in reversed(rounds):
        later = reduce(DataFrame.unionByName, known).withColumnsRenamed({v: f"sum_{v}" for v in values})
        found = staged(spliced.drop(*values).join(later, "id").select(F.col("via").alias("id"), *((F.col(f"add_{v}") + F.col(f"sum_{v}")).alias(v) for v in values)), "sums")
        scrap.append(found)
        known += [found.frame, leaves]
    out = staged(reduce(DataFrame.unionByName, known), "subtrees")
    for table in scrap:
        table.drop()
    return out


def _turn() -> Column:
    """Order in which the nodes of a chain go: odd depths, then odd multiples of two, and so on, so that a chain halves."""
    low = F.col("depth").bitwiseAND(-F.col("depth"))
    return F.struct(low.alias("low"), F.xxhash64("id").alias("mixed"), F.col("id").alias("name"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for node, rows in runs(batches, "id"):
        members = rows.column("conv_id").to_pylist()
        yield pa.record_batch([[node], [members[0]], [",".join(map(str, members))]], schema=pa.schema([("id", pa.binary()), ("first", pa.int64()), ("members", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for name, rows in runs(batches, "id"):
        if name != node:
            if node is not None:
                yield pa.record_batch([[node], [digest.hexdigest()]], schema=schema)
            node, digest, glue = name, hashlib.sha256(), b""
        for part in rows.column("members").to_pylist():
            digest.update(glue + part.encode())
            glue = b","
    if node is not None:
        yield pa.record_batch([[node], [digest.hexdigest()]], schema=schema)


def digests(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of its ``conv_id``s in ascending order, joined by commas: ``id, ends_sha256``.

    Ids are sorted over all tasks and joined there, a batch at a time; what comes together for
    one node is a row per batch, hashed as a stream, since SHA-256 reads its input in order.
    """
    sorted_ends = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    chunks = sorted_ends.mapInArrow(_joined, "id binary, first long, members string")
    return chunks.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_hashed, "id binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of all conversations' prefixes, one row per node.

    ``turns`` has ``conv_id, depth`` (1, 2, ... without gaps), ``key`` (equal for equal turns) and
    ``words`` (long); ``members`` has each ``conv_id`` once, also of conversations without turns.
    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs, n_children, n_leaves, saved_tokens`` and ``ends_sha256`` of the members
    that end there.

    Null ids take no part, no member means no rows, and conversations that are equal are members
    of the same nodes.  Other columns are ignored.
    """
    digest = F.md5(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(b":"), "key"))
    marks = turns.filter("conv_id is not null").select("conv_id", F.col("depth").cast("long").alias("depth"), "words", digest.alias("mark"))
    marks = staged(marks.select("conv_id", "depth", "words", _half(F.col("mark"), 1).alias("x"), _half(F.col("mark"), 17).alias("y"), F.floor(F.col("depth") / BLOCK).alias("block")), "marks")
    totals = marks.frame.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"), F.max("depth").alias("last"))
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.select("conv_id", "block", *(F.coalesce(F.bit_xor(t).over(upto), F.lit(0)).alias(c) for t, c in (("tx", "cx"), ("ty", "cy"))))
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paths = marks.frame.withColumns({"rx": F.bit_xor("x").over(running), "ry": F.bit_xor("y").over(running)}).join(blocks, ["conv_id", "block"]).select(
        "conv_id", "depth", "words", "x", "y", F.col("rx").bitwiseXOR(F.col("cx")).alias("px"), F.col("ry").bitwiseXOR(F.col("cy")).alias("py")
    )
    inner = paths.groupBy("px", "py").agg(
        F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.count("*").alias("n_convs"), F.any_value("words").alias("words"),
        F.any_value("x").alias("x"), F.any_value("y").alias("y"),
    ).select(
        _node("px", "py").alias("id"), F.unhex(F.concat(*(F.lpad(F.hex(F.col(p).bitwiseXOR(F.col(c))), 16, F.lit("0")) for p, c in (("px", "x"), ("py", "y"))))).alias("parent"),
        "conv_id", "depth", "n_convs", "words",
    )
    everyone = members.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"))
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words")
    )
    nodes = staged(inner.unionByName(root), "nodes")
    kids = nodes.frame.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    full = staged(nodes.frame.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    sums = subtree_sums(
        full.frame.select("id", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")),
        ["n_leaves", "saved_tokens"],
    )
    of_conv = totals.groupBy("conv_id").agg(F.bit_xor("tx").alias("px"), F.bit_xor("ty").alias("py"))
    ends = everyone.join(of_conv, "conv_id", "left").select("conv_id", F.coalesce(_node("px", "py"), F.lit(ROOT)).alias("id"))
    # A parent meets its children in groups by a hash of theirs, so none with very many is one task.
    child = full.frame.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    above = child.filter("parent is not null").select("parent", "salt").distinct().join(
        full.frame.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"
    )
    return (
        child.join(above, ["parent", "salt"], "left").join(sums.frame, "id").join(digests(ends), "id", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    )
