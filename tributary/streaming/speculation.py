"""Decisions that depend on earlier ones of the same key, taken in many tasks at a time.

The requests of a key are cut into chunks in time order.  Every chunk is scanned from an assumed list
of accepted stamps; what it leaves behind is what the next chunk should have started from.  Only chunks that
started from another list are scanned again, from the list that their forerunner leaves now, until
no chunk's start differs.  After round n the first n chunks of a key are final at least, and a chunk whose end does not
change for another start, which is the common case, stops the correction there.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import stage, unstage

#: Requests that one scan takes.
ROWS_PER_SCAN = 1 << 16


def admit(accepted: deque, at: int, limit: int, window: int) -> bool:
    """Decide one request; ``accepted`` holds the stamps that still count."""
    while accepted and accepted[0] <= at - window:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(at)
    return True


def _tails(unit: Sequence[str], limit: int, window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per chunk its first stamp, the list it started from and the list it leaves; rows come sorted."""
    names = [*unit, "_chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, first, start, stamps = None, 0, [], deque()
        for pdf in batches:
            done = []
            for name, at, before in zip(zip(*(pdf[c] for c in names)), pdf["_at"], pdf["_before"]):
                if name != current:
                    if current is not None:
                        done.append((*current, first, start, list(stamps)))
                    current, first, start = name, at, [int(x) for x in before]
                    stamps = deque(start)
                admit(stamps, at, limit, window)
            yield pd.DataFrame(done, columns=[*names, "first", "used", "left"])
        if current is not None:
            yield pd.DataFrame([(*current, first, start, list(stamps))], columns=[*names, "first", "used", "left"])

    return run


def _verdicts(unit: Sequence[str], keep: Sequence[str], limit: int, window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [*unit, "_chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stamps = None, deque()
        for pdf in batches:
            accepted = []
            for name, at, before in zip(zip(*(pdf[c] for c in names)), pdf["_at"], pdf["_before"]):
                if name != current:
                    current, stamps = name, deque(int(x) for x in before)
                accepted.append(admit(stamps, at, limit, window))
            yield pdf[list(keep)].assign(accepted=accepted)

    return run


def decided(rows: DataFrame, unit: Sequence[str], tie: str, keep: Sequence[str], limit: int, window: int, rows_per_scan: int = ROWS_PER_SCAN) -> DataFrame:
    """The columns ``keep`` of all rows, and ``accepted``: at most ``limit`` accepted stamps ``_at`` per ``window`` and ``unit``.

    Requests of a unit go by ``_at``, then ``tie``.  They are sorted over the whole table by ranges, so the requests of one
    unit spread over many tasks; no scan takes more than ``rows_per_scan`` of them, and it holds
    ``limit`` stamps at most.
    """
    unit, order = list(unit), [*unit, "_at", tie]
    chunk = [*unit, "_chunk"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stage(sorted_rows.withColumn("_chunk", F.floor(F.col("_id") / rows_per_scan)), "requests")
    thin = placed.select(*chunk, "_id", "_at")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*chunk).schema)

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*chunk).sortWithinPartitions(*chunk, "_id")

    def scanned(df: DataFrame) -> DataFrame:
        return in_order(df).mapInPandas(_tails(unit, limit, window), f"{kinds}, first bigint, used array<bigint>, left array<bigint>")

    nothing = F.array().cast("array<bigint>")
    chunks = stage(scanned(thin.withColumn("_before", nothing)), "scans")
    forerunner = F.lag("left").over(Window.partitionBy(*unit).orderBy("_chunk"))
    due = F.coalesce(F.filter(forerunner, lambda x: x > F.col("first") - window), nothing)
    while True:
        wrong = stage(chunks.withColumn("_before", due).filter(F.col("_before") != F.col("used")).select(*chunk, "_before"), "rescans")
        if wrong.isEmpty():
            unstage(wrong)
            break
        after = stage(chunks.join(wrong, chunk, "left_anti").unionByName(scanned(thin.join(wrong, chunk))), "scans")
        unstage(chunks)
        unstage(wrong)
        chunks = after
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    final = in_order(placed.join(chunks.select(*chunk, F.col("used").alias("_before")), chunk))
    return final.mapInPandas(_verdicts(unit, keep, limit, window), f"{schema}, accepted boolean")
