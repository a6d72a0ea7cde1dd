"""What the operators share: staged tables, words, bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import shared_dir

#: A word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Text bytes that one step of a Python worker holds at a time.  A single longer text is a step of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Staged:
    """A table written to the shared folder, so that later reads don't repeat the work and survive lost executors."""

    frame: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files; only for tables that no pending result reads."""
        spark = self.frame.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> Staged:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that no column has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text: Column | str) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def give_back() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step``, and what it freed goes back to the system at its end: a worker is used again, and the next step needs the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in runs of at most ``most`` text bytes or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group, held, start = [], 0, 0
    for row, n in enumerate(size.tolist()):
        if row > start and held + n > most:
            group.append((start, row))
            held, start = 0, row
        held += n
    group.append((start, batch.num_rows))
    for a, b in group:
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """The words of some texts: ``codes`` index ``distinct``; text i has the codes from starts[i] to starts[i + 1]."""

    distinct: pa.Array
    codes: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def words(texts: pa.Array) -> Words:
    """Split at ASCII white space; a null text has no words."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists).dictionary_encode()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = flat.dictionary
    real = np.asarray(pc.greater(pc.binary_length(distinct), 0), dtype=bool)
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Words(distinct, codes[keep], kept[np.concatenate([[0], ends]).astype(np.int64)])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of all i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at += np.arange(total)
    return at
