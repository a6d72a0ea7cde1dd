"""Near-duplicates: banded MinHash candidates, odd sketches, full-set confirmation.

A document's set of shingles gets MinHash samples.  Bands of samples form bucket
keys; the samples folded into a parity bitmap form its odd sketch, where the
population count of two sketches' XOR estimates a high similarity closely.  Pairs
that share a bucket and whose sketches don't rule them out are confirmed by their
full sets.

Documents with equal sets are one class from the start.  Buckets never yield all
their pairs.  First each class is held against the leaders of its buckets, and
confirmed links are joined into components.  A bucket whose classes are all in
one component is done, since more of its links cannot change a component.  In the
others, the classes outside the bucket's largest component are held against all its
classes, sketch against sketch, in blocks of a bucket; a block puts out no pairs, but those of
its rows that are near a class of another component.  Last, what is left of a bucket meets with full sets
and in blocks again, once for buckets of which the same classes are left; a block puts out fewer links than it has components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Staged, ragged, slices, staged, tidy, words
from tributary.llm.substrings import _joined, _mixed, rolling

#: At a similarity of 0.8, no band of 40 agrees for one pair in ten million.
BANDS, ROWS = 40, 5
SKETCH_BITS = 512
#: Pairs whose estimate is so far below the threshold are ruled out: four standard deviations of samples and sketch.
MARGIN = 0.14

#: Classes of a bucket whose sketches are compared in one task, and shingles of classes whose sets are.
BLOCK_CLASSES, BLOCK_SHINGLES = 4096, 250_000

_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each; where those of each text start."""
    found = words(pc.ascii_lower(texts))
    seen = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.distinct.to_pylist()), np.uint64, len(found.distinct))
    hashes = seen[found.codes] if len(seen) else np.zeros(0, np.uint64)
    counts, n = found.counts, len(hashes)
    values, owners = [], []
    for length in range(1, k + 1):  # a text of fewer words is a shingle as a whole
        rolled = rolling(hashes, length)
        if length == k:
            ok = np.arange(len(rolled)) + k <= np.repeat(found.starts[1:], counts)[: len(rolled)]
            places = np.flatnonzero(ok)
            owners.append(found.owner()[places])
        else:
            docs = np.flatnonzero(counts == length)
            places = found.starts[:-1][docs]
            owners.append(docs)
        values.append(_mixed(rolled[places] + np.uint64(length)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(value: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and odd sketches of sets that are not empty."""
    docs = len(starts) - 1
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    keys, flips = np.zeros((docs, bands), np.uint64), np.zeros(docs * SKETCH_BITS, np.int64)
    row = np.arange(docs) * SKETCH_BITS
    for i, seed in enumerate(seeds):
        sample = np.minimum.reduceat(value * seed, starts[:-1])
        keys[:, i // rows] = _joined(keys[:, i // rows] + np.uint64(i // rows), sample)
        bit = (_mixed(sample + seed) >> np.uint64(17)) % np.uint64(SKETCH_BITS)
        np.add.at(flips, row + bit.astype(np.int64), 1)
    sketch = np.packbits((flips & 1).astype(np.uint8).reshape(docs, SKETCH_BITS), axis=1).view(np.int64)
    return keys.view(np.int64), sketch


def _sign(k: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, starts = shingle_sets(part.column("text"), k)
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes)
                node: list[bytes | None] = [None] * part.num_rows
                for r in full.tolist():
                    node[r] = hashlib.blake2b(value[starts[r] : starts[r + 1]].tobytes(), digest_size=16).digest()
                keys, sketch = signatures(value, np.append(starts[:-1][full], len(value)), bands, rows) if len(full) else (np.zeros((0, bands), np.int64), np.zeros((0, len(_SKETCH)), np.int64))
                at = np.full(part.num_rows, -1)
                at[full] = np.arange(len(full))
                pick = pa.array(at, mask=at < 0)
                band = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sizes), pa.array(node, pa.binary()), band.take(pick), *(pa.array(sketch[:, i]).take(pick) for i in range(len(_SKETCH)))],
                    ["doc_id", "text_key", "n_shingles", "node", "bands", *_SKETCH],
                )

    return run


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, starts = shingle_sets(part.column("text"), k)
                yield pa.record_batch([part.column("node"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(value.view(np.int64)))], ["node", "shingles"])

    return run


def far_bits(similarity: float, samples: int) -> int:
    """The most bits in which the sketches of a pair at ``similarity`` may differ on average."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / SKETCH_BITS)))


def _near(a: str, b: str, percent: int, samples: int) -> Column:
    """Whether neither the sizes nor the sketches of two classes rule a link out."""
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH), F.lit(0))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * percent) & (apart <= far_bits(percent / 100 - MARGIN, samples))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step towards stars: each node passes its least neighbour to its larger ones (or to its smaller ones and itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> Staged:
    """The least node that each node of the edges (a, b) can reach, as (node, component), by alternating stars."""
    kept, mark = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        now = kept.frame.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
        after = staged(_star(_star(kept.frame, True), False), "edges")
        kept.drop()
        kept = after
    found = staged(
        kept.frame.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(kept.frame.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(),
        "components",
    )
    kept.drop()
    return found


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are similar enough."""
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent)
        .select("a", "b")
    )


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(s).to_numpy() for s in _SKETCH], axis=1).view(np.uint64)


def _runs(names: list[object]) -> Iterator[tuple[object, np.ndarray]]:
    """The rows of each name."""
    at: dict[object, list[int]] = {}
    for i, name in enumerate(names):
        at.setdefault(name, []).append(i)
    return ((name, np.array(rows)) for name, rows in at.items())


_ASKED = "key long, node binary, own binary, asks boolean"


def _asked(percent: int, samples: int) -> Callable[[pa.Table], pa.Table]:
    """The rows, of those given, of classes that ask and are near a class of another component by sketch and size, and of those others."""
    most = far_bits(percent / 100 - MARGIN, samples)

    def run(table: pa.Table) -> pa.Table:
        sketch, n = _sketches(table), table.column("n").to_numpy()
        code, asks = _codes(table.column("component"))[0], np.array(table.column("asks").to_pylist(), bool)
        near_any = np.zeros(table.num_rows, bool)
        for _, rows in _runs(table.column("key").to_pylist()):
            held = rows[~asks[rows]]
            for i in rows[asks[rows]].tolist():
                other = held[code[held] != code[i]]
                near = np.bitwise_count(sketch[i] ^ sketch[other]).sum(1) <= most
                near &= np.minimum(n[i], n[other]) * 100 >= np.maximum(n[i], n[other]) * percent
                near_any[other[near]] = True
                near_any[i] |= near.any()
        return table.filter(pa.array(near_any)).select(["key", "node", "component", "asks"]).rename_columns(["key", "node", "own", "asks"])

    return run


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each distinct value, row by row, and the values by number."""
    values = column.to_pylist()
    at = {c: i for i, c in enumerate(dict.fromkeys(values))}
    return np.array([at[c] for c in values], np.int64), list(at)


def _linked(percent: int, samples: int) -> Callable[[pa.Table], pa.Table]:
    """Links that join the components as all links of a cell do: whoever asks in a bucket against its other classes.

    A class of a component that the cell's links already reach is not looked at again, so there are fewer links than components.
    """
    most = far_bits(percent / 100 - MARGIN, samples)

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("shingles").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(starts)
        sketch, asks = _sketches(table), np.array(table.column("asks").to_pylist(), bool)
        code, names = _codes(table.column("own"))
        joined = np.arange(len(names))
        links: list[tuple[bytes, bytes]] = []
        for _, rows in _runs(table.column("key").to_pylist()):
            held = rows[~asks[rows]]
            values = flat[ragged(starts[held], sizes[held])]
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(held)), sizes[held])[order]
            for i in rows[asks[rows]].tolist():
                near = joined[code[held]] != joined[code[i]]
                near &= np.bitwise_count(sketch[i] ^ sketch[held]).sum(1) <= most
                if not near.any():
                    continue
                mine = flat[starts[i] : starts[i + 1]]
                low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                common = np.bincount(owner[ragged(low, high - low)], minlength=len(held))
                similar = near & (common * 100 >= (len(mine) + sizes[held] - common) * percent)
                for other in np.unique(code[held[similar]]).tolist():
                    if joined[other] != joined[code[i]]:
                        links.append((names[code[i]], names[other]))
                        joined[joined == joined[other]] = joined[code[i]]
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return run


def _one_of_equal(rows: DataFrame) -> DataFrame:
    """Of buckets with the same rows (node, asks) those of one, told by two 64-bit hashes and the count."""
    sets = rows.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node", "asks")).alias("x"), F.bit_xor(F.xxhash64("asks", "node")).alias("y"))
    return rows.join(sets.groupBy("rows", "x", "y").agg(F.min("key").alias("key")), "key", "left_semi")


def _cells(rows: DataFrame, by: str, weight: Column, most: int, label: str) -> DataFrame:
    """Deal rows with ``asks`` into cells, so that in each group ``by`` every row that asks meets every other row in one cell.

    A group of more than ``most`` of ``weight`` on a side is cut into blocks, and each pair of blocks is a cell; small groups
    share cells by hash.
    """
    asks = F.col("asks")
    sums = [F.coalesce(F.sum(F.when(side, weight)), F.lit(0)).alias(name) for side, name in ((asks, "asked"), (~asks, "held"))]
    sizes = staged(rows.groupBy(by).agg(*sums).filter("asked > 0 and held > 0"), label).frame
    total = sizes.agg(F.coalesce(F.sum(F.col("asked") + F.col("held")), F.lit(0))).first()[0]
    blocks = sizes.select(by, *(F.ceil(F.col(c) / most).cast("long").alias(f"{c}_blocks") for c in ("asked", "held")))
    dealt = rows.join(blocks, by)
    spread, last = F.xxhash64("node"), lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine = lambda c: F.array(F.pmod(spread, F.col(c)))
    dealt = dealt.withColumn("i", F.explode(F.when(asks, mine("asked_blocks")).otherwise(last("asked_blocks"))))
    dealt = dealt.withColumn("j", F.explode(F.when(asks, last("held_blocks")).otherwise(mine("held_blocks"))))
    small = (F.col("asked_blocks") == 1) & (F.col("held_blocks") == 1)
    cell = F.when(small, F.pmod(F.xxhash64(by), F.lit(total // most + 1))).otherwise(F.xxhash64(by, "i", "j"))
    return dealt.withColumn("cell", F.struct(small.alias("small"), cell.alias("at"))).drop("i", "j", "asked_blocks", "held_blocks")


def _ordered(doc_id: str, node: str) -> Column:
    """A class by its smallest document id and its set: bytes that sort by that id."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.col(node))


def _id_of(node: str) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: the digest of their text, where null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, keyed: bool = False
) -> DataFrame:
    """Group documents whose sets of ``k``-word shingles are linked by a Jaccard similarity of ``percent`` / 100 or more.

    Words are split at ASCII white space after A-Z are lower-cased; a text of fewer
    than ``k`` words is one shingle.  Returns ``doc_id, n_shingles, component_id,
    kept`` for each row: the smallest id reachable over links, and whether it is the
    row's own.

    Null and empty texts have no shingles, are linked with nothing and kept.  Rows
    without an id take no part: their component is null and they are kept.  Equal
    rows are one class and get equal answers; rows that share an id are told apart by
    their text.  Other columns are ignored.  An empty table gives no rows.  With
    ``keyed``, each row also has its ``text_key`` and its ``group``, which differs for
    different groups whose smallest ids are equal; it is null where the row takes no part.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("text_key", text_key(F.col("text")))
    schema = "doc_id long, text_key binary, n_shingles long, node binary, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)
    signed = staged(source.mapInArrow(tidy(_sign(k, bands, rows)), schema), "signatures").frame
    with_id = signed.filter("doc_id is not null and node is not null")
    classes = staged(
        with_id.groupBy("node").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"),
            *(F.any_value(s).alias(s) for s in _SKETCH),
        ).select(F.col("node").alias("set_key"), "first.doc_id", "first.text_key", "n", "bands", *_SKETCH)
        .withColumn("node", _ordered("doc_id", "set_key")),
        "classes",
    ).frame
    thin = classes.select("node", "n", *_SKETCH)
    buckets = classes.select("node", F.explode("bands").alias("key"))
    # What is joined on a bucket is written first: such a join may be split where a bucket is large.
    sizes = staged(buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes").frame
    shared = staged(buckets.join(sizes, "key"), "shared").frame
    # The class that meets most others is likeliest the text that the others were made from.
    meets = shared.groupBy("node").agg(F.sum("size").alias("meets"))
    shared = staged(shared.drop("size").join(meets, "node"), "buckets").frame

    # A class is read from the one document that stands for it; other texts go no further than this join.
    wanted = classes.join(meets, "node", "left_semi").select("node", "doc_id", "text_key")
    sets = staged(
        source.join(wanted, ["doc_id", "text_key"]).select("node", "text").mapInArrow(tidy(_sets(k)), "node binary, shingles array<long>")
        .groupBy("node").agg(F.any_value("shingles").alias("shingles")),
        "sets",
    ).frame

    # Each class against the leaders of its buckets.
    leaders = staged(shared.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("lead")).select("key", F.col("lead.node").alias("leader")), "leaders").frame
    pairs = shared.join(leaders, "key").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = pairs.join(thin.alias("x").withColumnRenamed("node", "a"), "a").join(thin.alias("y").withColumnRenamed("node", "b"), "b")
    star = staged(pairs.filter(_near("x", "y", percent, bands * rows)).select("a", "b"), "stars").frame
    groups = components(_confirmed(star, sets, percent)).frame

    # Buckets that still hold several components.
    member = shared.select("key", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = member.groupBy("key", "component").agg(F.count("*").alias("rows"))
    tops = staged(parts.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("key", F.col("top.component").alias("largest")), "open").frame
    rows_open = member.join(tops, "key").withColumn("asks", F.explode(F.when(F.col("component") != F.col("largest"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    rows_open = staged(rows_open.drop("largest").join(thin, "node"), "open-rows").frame
    asked = _cells(rows_open, "key", F.lit(1), BLOCK_CLASSES, "open-sizes").groupBy("cell").applyInArrow(_asked(percent, bands * rows), _ASKED)
    asked = staged(asked.distinct(), "asked-rows").frame
    asked = staged(_one_of_equal(asked).join(thin, "node"), "asked").frame
    meet = _cells(asked, "key", F.col("n"), BLOCK_SHINGLES, "asked-sizes").join(sets, "node")
    between = components(meet.groupBy("cell").applyInArrow(_linked(percent, bands * rows), "a binary, b binary")).frame
    answer = (
        classes.select("set_key", "node").join(groups, "node", "left").withColumn("inner", F.coalesce("component", "node"))
        .join(between.select(F.col("node").alias("inner"), F.col("component").alias("outer")), "inner", "left")
        .select(F.col("set_key").alias("node"), F.coalesce("outer", "inner").alias("group")).withColumn("component_id", _id_of("group"))
    )
    more_columns = ["text_key", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group")] if keyed else []
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.select("doc_id", "text_key", "n_shingles", "node").join(answer, "node", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), *more_columns)
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, and of each group of ``near_duplicates`` one row: that of the smallest id.

    Rows that share an id are told apart by their text: of a group's rows of the smallest
    id one text stays, and of equal rows one.  Rows without an id or any word stay.  Columns of
    any name come back as they are; an empty table gives no rows.
    """
    found = near_duplicates(docs, k, percent, doc_id, text, keyed=True).filter("group is not null")
    texts = staged(found.groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("copies")), "texts").frame
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("group", "first.*")
    gone = texts.join(first, ["group", "doc_id", "text_key"], "left_anti").select("doc_id", "text_key", F.lit(0).alias("copies"))
    repeated = texts.filter("copies > 1").join(first, ["group", "doc_id", "text_key"], "left_semi").select("doc_id", "text_key", "copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("text_key"))
    if repeated.isEmpty():
        return rows.join(gone, ["doc_id", "text_key"], "left_anti").select("row.*")
    marked = rows.join(gone.unionByName(repeated), ["doc_id", "text_key"], "left")
    once = marked.filter("copies > 0").groupBy("doc_id", "text_key").agg(F.min("row").alias("row"))
    return marked.filter("copies is null").select("row.*").unionByName(once.select("row.*"))
