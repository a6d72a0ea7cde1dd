"""Turns of conversations in order, and each one's place, without collecting a conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import WORD, Staged, staged


def numbered(rows: DataFrame, order: list[str], keep: list[Column | str], label: str) -> Staged:
    """The columns ``keep`` of all rows, and ``at``: a number that grows in the order of ``order``.

    The rows are sorted over the whole table by ranges, so a key with very many rows spreads
    over many tasks; equal rows do too.  ``at`` holds the range in its upper bits and counts
    on by one within it.  It is written out before use, so a row keeps its number.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [*order, "_tie"]
    return staged(tied.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("at")), label)


def part_of(at: Column | str = "at") -> Column:
    """The range of a number from ``numbered``."""
    return F.shiftright(F.col(at) if isinstance(at, str) else at, 33)


def parts(rows: DataFrame, key: str) -> DataFrame:
    """Per key and range: ``key, part, first, n, before, total`` rows; one row for each range that a key touches."""
    counted = rows.groupBy(key, part_of().alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(key)
    upto = w.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.select(key, "part", "first", "n", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))


def turn_key(role: Column, text: Column) -> Column:
    """What equal turns share: a digest of role and text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).cast("long")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The key and the rows of each run of equal keys, run by run within a batch."""
    for batch in batches:
        names = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                yield names[start], batch.slice(start, i - start)
                start = i
