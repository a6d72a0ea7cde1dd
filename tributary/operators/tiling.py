"""Many-to-many joins of hot keys in tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import stage

#: Rows of a key that one tile takes of each side.
TILE = 50_000


def tiles(left: DataFrame, right: DataFrame, on: Sequence[str], tile: int, label: str = "tiles") -> DataFrame:
    """``(on, rows, columns)``: into how many parts each side of a key that both sides hold is cut.

    The counts are partial sums before the shuffle.  The table is staged: a join with it may be
    split where a key is hot, or sent to all tasks if its size allows.
    """
    on = list(on)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))

    return stage(counted(left, "_rows").join(counted(right, "_columns"), on), label)


def tiled_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_spread: Sequence[str],
    right_spread: Sequence[str],
    tile: int = TILE,
    label: str = "tiles",
) -> DataFrame:
    """Inner join on ``on`` in which no task meets more than about ``tile`` rows of a key on either side.

    The pairs of a key with m rows here and n there are a rectangle.  Both sides are cut, by hashes of their
    ``spread`` columns, and each tile of the rectangle is a join key of its own: a row goes to all
    tiles of its stripe, so m * n pairs move (m * n / tile) rows on each side and no more than that.  Keys that
    fit into one tile, which are nearly all, move once.
    """
    on = list(on)
    cut = tiles(left, right, on, tile, label)

    def stripe(df: DataFrame, spread: Sequence[str], own: str, other: str) -> DataFrame:
        mine: Column = F.pmod(F.xxhash64(*spread), F.col(own)).cast("int")
        rows = df.join(cut, on).withColumn(f"{own}_at", mine)
        return rows.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_rows", "_columns")

    at = ["_rows_at", "_columns_at"]
    return stripe(left, left_spread, "_rows", "_columns").join(stripe(right, right_spread, "_columns", "_rows"), [*on, *at]).drop(*at)
