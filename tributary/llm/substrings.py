"""Substring dedup: fixed-block anchors.

A window of ``window`` words always holds a whole block of ``(window + 1) // 2``
words whose place in its document is a multiple of the block's length.  So if the
non-overlapping blocks of all documents are indexed and every rolling window of
a block's length probes that index, each repeated window has a hit in either
copy.  Hits are then extended: the full windows over them are compared as whole
windows, and runs of repeated windows make up the maximal repeats.

Documents are held as slices, rows of a few megabytes.  A slice sends each
distinct block hash once, with two flags, to the shard that owns its range of
hashes; the shard answers with one bit per hash.  A passage in a third of all
documents is thus at most one entry per slice, and no task gathers its
occurrences.  Slices, shards and entries grow with the input; their sizes don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import Words, slices, staged, tidy, words

#: Words of the input per shard of the index.
SHARD_WORDS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring runs of words."""
    return _mixed(left * _ODD + _mixed(right))


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for the run of ``length`` words at each place; the last places have none."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, hashes, 1
    while True:
        if length & size:
            out = power if out is None else _joined(out[: len(power) - done], power[done:])
            done += size
        if done == length:
            return out[: len(hashes) - length + 1]
        power = _joined(power[:-size], power[size:])
        size *= 2


@dataclass
class Slice:
    """The documents of a slice as words, and the places at which windows start."""

    found: Words
    blocks: np.ndarray  # hash of the block at each place that has one
    block_places: np.ndarray
    aligned: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, block: int) -> Slice:
        found = words(texts)
        seen = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.distinct.to_pylist()), np.uint64, len(found.distinct))
        hashes = seen[found.codes] if len(seen) else np.zeros(0, np.uint64)
        rolled = rolling(hashes, block)
        places = np.flatnonzero(_inside(found, block)[: len(rolled)])
        offset = np.arange(len(hashes)) - np.repeat(found.starts[:-1], found.counts)
        return cls(found, rolled[places], places, offset[places] % block == 0)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct block hashes, sorted: 46 bits, then a bit each for an aligned and for a repeated one; where each place's is.

        Hashes that meet in these bits cost a needless hit, which the extension refutes.
        """
        keys, which, count = np.unique(self.blocks >> np.uint64(18), return_inverse=True, return_counts=True)
        index = np.zeros(len(keys), bool)
        index[which[self.aligned]] = True
        return keys << np.uint64(2) | index.astype(np.uint64) << np.uint64(1) | (count > 1).astype(np.uint64), which

    def extended(self, hits: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows that hold a hit: places, and per distinct one two hashes (the second with a bit for a repeated one); where each place's is."""
        n = int(self.found.starts[-1])
        hit, block_at = np.zeros(n + 1, np.int64), np.zeros(n, np.uint64)
        hit[self.block_places[hits]] = 1
        block_at[self.block_places] = self.blocks
        upto = np.concatenate([[0], np.cumsum(hit)])
        reach = window - block
        fits = np.flatnonzero(_inside(self.found, window))
        fits = fits[upto[fits + reach + 1] > upto[fits]]
        first, last = block_at[fits], block_at[fits + reach]
        high, low = _joined(first, last), _joined(last ^ _ODD, first) >> np.uint64(33) << np.uint64(1)
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        again = (np.bincount(which, minlength=int(new.sum())) > 1).astype(np.uint64)
        return fits, high[order][new], low[order][new] | again, which


def _inside(found: Words, length: int) -> np.ndarray:
    """Whether a run of ``length`` words that starts at a place stays within its document."""
    return np.arange(int(found.starts[-1])) + length <= np.repeat(found.starts[1:], found.counts)


def _pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpack(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def _shard_edges(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's range of hashes starts among sorted keys."""
    starts = [(s << bits) // shards for s in range(shards)]
    return np.concatenate([np.searchsorted(keys, np.array(starts, np.uint64)), [len(keys)]])


def _sliced(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, text):
                n = int(words(rows.column(text)).starts[-1])
                yield pa.record_batch([pa.array([name]), pa.array([n]), pa.array([_pack(rows)], pa.binary())], ["slice", "n_words", "rows"])
                name += 1

    return run


ENTRIES = "slice long, shard int, keys binary, more binary"
ANSWERS = "slice long, shard int, step int, bits binary"


def _entries(name: int, keys: np.ndarray, more: np.ndarray | None, shards: int) -> Iterator[pa.RecordBatch]:
    """A row per shard: block hashes in six bytes each, or window hashes in eight and four."""
    edges = _shard_edges(keys, shards, 48 if more is None else 64)
    wire = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2 if more is None else 0 :]
    rest = np.zeros(0, np.uint32) if more is None else more.astype(np.uint32)
    for s in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[s], edges[s + 1]
        yield pa.record_batch([
            pa.array([name]), pa.array([s], pa.int32()), pa.array([wire[a:b].tobytes()], pa.binary()), pa.array([rest[a:b].tobytes()], pa.binary())
        ], ["slice", "shard", "keys", "more"])


def _keys(blobs: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    out = []
    for x in (x for c in blobs.chunks for x in c):
        wire = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, size)
        full = np.zeros((len(wire), 8), np.uint8)
        full[:, 8 - size :] = wire
        out.append(full.view(">u8").ravel().astype(np.uint64))
    return out


def _probe(text: str, block: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column("slice").to_pylist(), batch.column("rows"), strict=True):
                keys, _ = Slice.of(_unpack(rows).column(text), block).anchors()
                yield from _entries(name, keys, None, shards)

    return run


def _answer(step: int, group: pa.Table, hit: Callable[[np.ndarray, list[pa.Scalar]], np.ndarray], keys: list[np.ndarray]) -> pa.Table:
    """One bit per entry, for the slices that have any hit."""
    ends = np.cumsum([len(k) for k in keys])
    good = hit(np.concatenate(keys), [x for c in group.column("more").chunks for x in c])
    out = [np.packbits(x).tobytes() if x.any() else None for x in np.split(good, ends[:-1])]
    return pa.table({
        "slice": group.column("slice"), "shard": group.column("shard"),
        "step": pa.array(np.full(len(out), step, np.int32)), "bits": pa.array(out, pa.binary()),
    }).filter(pa.compute.is_valid(pa.array(out, pa.binary())))


def _index(group: pa.Table) -> pa.Table:
    """A block hash is a hit if it is aligned somewhere and found twice or more."""
    keys = _keys(group.column("keys"), 6)

    def hit(all_keys: np.ndarray, _: list[pa.Scalar]) -> np.ndarray:
        _, which = np.unique(all_keys >> np.uint64(2), return_inverse=True)
        times = np.bincount(which, weights=1 + (all_keys & np.uint64(1)))
        aligned = np.bincount(which, weights=all_keys >> np.uint64(1) & np.uint64(1))
        return ((times > 1) & (aligned > 0))[which]

    return _answer(0, group, hit, keys)


def _repeats(group: pa.Table) -> pa.Table:
    """A window is a repeat if it starts at two places or more."""
    keys = _keys(group.column("keys"), 8)

    def hit(high: np.ndarray, more: list[pa.Scalar]) -> np.ndarray:
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in more])
        order = np.lexsort((low >> 1, high))
        a, b = high[order], low[order] >> 1
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return (np.bincount(which, weights=1 + (low & 1)) > 1)[which]

    return _answer(1, group, hit, keys)


def _bits(answers: pa.Table, step: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The answers to a slice's sorted keys."""
    edges, out = _shard_edges(keys, shards, 64 if step else 48), np.zeros(len(keys), bool)
    mine = answers.filter(pa.compute.equal(answers.column("step"), step))
    for s, bits in zip(mine.column("shard").to_pylist(), mine.column("bits").to_pylist(), strict=True):
        n = edges[s + 1] - edges[s]
        out[edges[s] : edges[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def _extend(text: str, window: int, block: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for name, rows in zip(docs.column("slice").to_pylist(), docs.column("rows"), strict=True):
            held = Slice.of(_unpack(rows).column(text), block)
            keys, which = held.anchors()
            _, high, low, _ = held.extended(_bits(answers, 0, keys, shards)[which], window, block)
            out += _entries(name, high, low, shards)
        return pa.Table.from_batches(out) if out else pa.table({"slice": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "more": pa.array([], pa.binary())})

    return run


def _removed(text: str, window: int, block: int, shards: int, rejoin: bool, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for blob in docs.column("rows"):
            rows = _unpack(blob)
            held = Slice.of(rows.column(text), block)
            keys, which = held.anchors()
            places, high, _, each = held.extended(_bits(answers, 0, keys, shards)[which], window, block)
            places = places[_bits(answers, 1, high, shards)[each]]
            found = held.found
            edge = np.zeros(int(found.starts[-1]) + 1, np.int64)
            edge[places] += 1
            np.subtract.at(edge, places + window, 1)
            kept = np.cumsum(edge)[:-1] == 0
            upto = np.concatenate([[0], np.cumsum(kept)])
            left = (upto[found.starts[1:]] - upto[found.starts[:-1]]).astype(np.int64)
            flat = pa.DictionaryArray.from_arrays(pa.array(found.codes[kept]), found.distinct).cast(pa.large_string())
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)])), flat)
            text_left = pa.compute.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            gone = found.counts - left
            old = rows.column(text)
            new = pa.compute.if_else(pa.array(np.full(len(left), rejoin) | (gone > 0)), pa.compute.if_else(pa.compute.is_null(old), pa.scalar(None, pa.string()), text_left), old.cast(pa.string()))
            values = {**{n: rows.column(n) for n in rows.schema.names}, text: new, "n_words": pa.array(found.counts), "n_removed": pa.array(gone)}
            out.append(pa.table([values[n] for n in names], names))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.null()) for n in names})

    return run


def drop_repeats(docs: DataFrame, window: int = 35, text: str = "text", rejoin: bool = False) -> DataFrame:
    """Take every word out that lies in a window of ``window`` words which also starts anywhere else.

    Windows are runs of words of one document, judged on the input.  All rows
    and columns come back, with ``text`` replaced by its kept words joined by one
    space where anything was removed (with ``rejoin``, in every row), and with
    ``n_words`` and ``n_removed``; columns of these two names are replaced.

    A null text has no words and stays null; an empty one stays empty.  Equal rows
    repeat each other.  A text shorter than the window keeps all its words, unless
    nothing else.  An empty table gives no rows.  Windows are compared by 95 bits
    of hashes of whole windows.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    own = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    source = docs.select(*[F.col(f"`{c}`") for c in own])
    held = staged(source.mapInArrow(tidy(_sliced(text)), "slice long, n_words long, rows binary"), "slices").frame
    total = held.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    probes = held.select("slice", "rows").mapInArrow(tidy(_probe(text, block, shards)), ENTRIES)
    hits = staged(probes.groupBy("shard").applyInArrow(_index, ANSWERS), "hits").frame
    by_slice = held.select("slice", "rows").groupBy("slice")
    windows = by_slice.cogroup(hits.groupBy("slice")).applyInArrow(_extend(text, window, block, shards), ENTRIES)
    repeats = staged(windows.groupBy("shard").applyInArrow(_repeats, ANSWERS), "repeats").frame
    schema = T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return by_slice.cogroup(hits.unionByName(repeats).groupBy("slice")).applyInArrow(
        _removed(text, window, block, shards, rejoin, schema.names), schema
    )
