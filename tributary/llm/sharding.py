"""Sharding: extendible hashing.

A directory is indexed by the leading bits of a hash of the row's key.  A bucket that
holds more bytes than a shard may is split on one more bit, and only such buckets are;
so each bucket's depth is the least at which its prefix fits.

Bytes are first summed per cell, a prefix longer than most buckets need, and the
directory is grown on the cells.  Rows whose cell is still too large go on with more
bits.  Rows with equal keys cannot be told apart by any bit: if they are too many for
a shard, they go on with the bits of a hash of a number of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import staged

#: Bits of the key's hash, and of the number of a row among rows with equal keys.
BITS = 60
#: The column by which shards are written to folders.
FOLDER = "_shard"

#: Bits beyond those that equal buckets would need, in the first round; bits per later round.
SPARE, STEP = 4, 8


def hashed(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column | str, depth: Column) -> Column:
    return F.call_function("shiftright", F.col(h) if isinstance(h, str) else h, F.lit(BITS) - depth)


def _depths(rows: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """The cells ``root, cell`` of ``last`` bits whose bucket fits at a depth from ``first`` on, with the least such ``depth``.

    A bucket is one of the directory if it fits and the one it was split from did not; each parent has two
    children at most, so no join here has a hot key.  Its cells are counted out from its prefix.
    """
    cells = rows.groupBy("root", _prefix("h", F.lit(last)).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(
        "prefix", F.call_function("shiftright", F.col("cell"), F.lit(last) - F.col("depth"))
    )
    sums = staged(levels.groupBy("root", "depth", "prefix").agg(F.sum("n_bytes").alias("held")), "levels").frame
    split = sums.filter(F.col("held") > limit).select("root", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = sums.filter(F.col("held") <= limit).withColumn("parent", F.shiftright("prefix", 1))
    top = fits.filter(F.col("depth") == first)
    found = top.unionByName(fits.filter(F.col("depth") > first).join(split, ["root", "depth", "parent"], "left_semi").select(*top.columns))
    below = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(last) - F.col("depth"))
    return found.select("root", "depth", F.explode(F.sequence(F.col("prefix") * below, (F.col("prefix") + 1) * below - 1)).alias("cell"))


def _grown(rows: DataFrame, limit: int, bits: int, columns: list[str]) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows with the depth and prefix of their bucket, and those that no depth separates."""
    done: list[DataFrame] = []
    first, last = 0, min(BITS, bits)
    while True:
        cell = _prefix("h", F.lit(last))
        placed = staged(rows.withColumn("cell", cell).join(_depths(rows, first, last, limit), ["root", "cell"], "left").select(*columns, "depth"), "shards").frame
        done.append(placed.filter("depth is not null").withColumn("prefix", _prefix("h", F.col("depth"))))
        rows = placed.filter("depth is null").select(*columns)
        if rows.isEmpty():
            return done, None
        if last == BITS:
            return done, rows
        first, last = last + 1, min(BITS, last + STEP)


def _bits(prefix: str, depth: str) -> Column:
    return F.when(F.col(depth) == 0, "").otherwise(F.lpad(F.bin(prefix), F.col(depth), F.lit("0")))


def shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shard of every row: ``key, shard, depth, n_bytes, oversized``.

    ``shard`` spells the hash bits that lead to it and ``depth`` their number; rows with
    equal keys that are too many for one shard have more bits after a slash.  No shard
    holds more than ``limit`` bytes of text, but for a row that is larger by itself: it
    is a shard of its own, marked ``oversized``.

    A null text has 0 bytes; null keys are equal keys.  Equal rows are placed one by
    one.  Other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.octet_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("long").alias("n_bytes"))
    rows = staged(rows.withColumn("h", hashed(F.col("key"))).withColumn("root", F.lit(0).cast("long")), "sizes").frame
    large = rows.filter(F.col("n_bytes") > limit)
    small = rows.filter(F.col("n_bytes") <= limit)
    total = small.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(total / limit, 1)))) + SPARE
    columns = ["key", "n_bytes", "h", "root"]
    done, equal = _grown(small, limit, bits, columns)
    out = [d.select("key", _bits("prefix", "depth").alias("shard"), "depth", "n_bytes", F.lit(False).alias("oversized")) for d in done]
    if equal is not None:
        # Written out before use, so a row keeps its number if an executor is lost.
        numbered = staged(equal.withColumn("root", F.col("h")).withColumn("h", hashed(F.monotonically_increasing_id())), "equal").frame
        more, rest = _grown(numbered, limit, STEP, columns)
        for d in more:
            bits_of = F.concat(F.lpad(F.bin("root"), F.lit(BITS), F.lit("0")), F.lit("/"), _bits("prefix", "depth"))
            out.append(d.select("key", bits_of.alias("shard"), (F.col("depth") + BITS).alias("depth"), "n_bytes", F.lit(False).alias("oversized")))
        if rest is not None:
            raise ValueError("two numbers share a hash")
    own = F.concat(F.lpad(F.bin("h"), F.lit(BITS), F.lit("0")), F.lit("/"), F.lpad(F.bin(hashed(F.monotonically_increasing_id())), F.lit(BITS), F.lit("0")))
    out.append(large.select("key", own.alias("shard"), F.lit(2 * BITS).alias("depth"), "n_bytes", F.lit(True).alias("oversized")))
    result = out[0]
    for frame in out[1:]:
        result = result.unionByName(frame)
    return result.withColumnRenamed("key", key)


def directory(placed: DataFrame) -> DataFrame:
    """One row per shard: ``shard, depth, rows, n_bytes``."""
    return placed.groupBy("shard", "depth").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a folder per shard below ``path`` and return the directory; keys must be unique and not null.

    A folder is named by ``FOLDER`` and the shard's bits after a letter, so that readers that look for numbers
    in folder names keep ``001`` and ``01`` apart; a slash in a shard's name becomes ``-``.  The column ``FOLDER`` of the
    files read back spells that name; a column of this name in ``docs`` is replaced.  An empty table
    writes no folder.
    """
    placed = staged(shards(docs, limit, key, text), "placed").frame
    name = F.concat(F.lit("b"), F.translate("shard", "/", "-"))
    rows = docs.drop(FOLDER).join(placed.select(F.col(f"`{key}`"), name.alias(FOLDER)), key)
    rows.repartition(FOLDER).sortWithinPartitions(FOLDER).write.partitionBy(FOLDER).parquet(path)
    return directory(placed)
