"""Convex hulls of grouped points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.extremes import outer_points

#: Groups a task keeps open before it hands on their partial hulls.
_HELD_GROUPS = 50_000


def ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull of points in counter-clockwise order from the leftmost one."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(path) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in path:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2:]
                if (bx - ax) * (y - ay) > (by - ay) * (x - ax):
                    break
                out.pop()
            out.append((x, y))
        return out[:-1]

    return chain(points) + chain(points[::-1])


def _coordinates(points: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    return points.select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def _finite() -> Column:
    ok = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & ~F.isnan("x") & ~F.isnan("y")
    return F.coalesce(ok, F.lit(False))


def rejected(points: DataFrame, group: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``(group, x, y)``: the points that ``hulls`` leaves out, since a coordinate is null, NaN or infinite."""
    return _coordinates(points, group, x, y).filter(~_finite())


def hulls(points: DataFrame, group: Sequence[str], x: str = "x", y: str = "y", buckets: int = 64) -> DataFrame:
    """``(group, seq, x, y)``: hull vertices of every group.

    What lies inside the polygon of a group's farthest points goes first, by built-in
    functions (``operators.extremes``).  Hulls compose: the hull of hulls is the hull of all points.  Each task
    reduces its own rows that are left, batch by batch, without a shuffle; the vertices
    of many tasks then merge per bucket of tasks and at last per group.  Two
    points are returned as they are; fewer give nothing.  Points that are not
    finite take no part; ``rejected`` returns them.
    """
    group = list(group)
    finite = _coordinates(points, group, x, y).filter(_finite())
    counted = finite.groupBy(*group).agg(F.count(F.lit(1)).alias("_points")).filter("_points > 1")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in finite.schema if f.name in group)
    fields = f"{keys}, seq int, x double, y double"

    def frame(held: dict[tuple, list[tuple[float, float]]]) -> pd.DataFrame:
        rows = [(*key, seq, px, py) for key, vertices in held.items() for seq, (px, py) in enumerate(vertices)]
        return pd.DataFrame(rows, columns=[*group, "seq", "x", "y"])

    def within_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[tuple[float, float]]] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(group, dropna=False, sort=False):
                held[key] = ring(held.get(key, []) + list(zip(rows["x"], rows["y"])))
            if len(held) > _HELD_GROUPS:
                yield frame(held)
                held = {}
        yield frame(held)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return frame({key[: len(group)]: ring(list(zip(pdf["x"], pdf["y"])))})

    local = outer_points(finite, group).mapInPandas(within_task, fields)
    bucketed = local.withColumn("_b", F.pmod(F.spark_partition_id(), F.lit(buckets)))
    partial = bucketed.groupBy(*group, "_b").applyInPandas(merge, fields)
    merged = partial.groupBy(*group).applyInPandas(merge, fields)
    return merged.join(counted.select(*group), group, "left_semi")


def expand(hull: DataFrame, group: Sequence[str], padding: float = 28.0) -> DataFrame:
    """Push vertices away from the centroid; small hulls stay unchanged."""
    w = Window.partitionBy(*group)
    rows = hull.withColumns(
        {"_cx": F.avg("x").over(w), "_cy": F.avg("y").over(w), "_n": F.count(F.lit(1)).over(w)}
    )
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    dist = F.hypot(dx, dy)
    dist = F.when(dist == 0, 1.0).otherwise(dist)
    small = F.col("_n") < 3
    return rows.select(
        *group,
        "seq",
        F.when(small, F.col("x")).otherwise(F.col("x") + dx / dist * padding).alias("x"),
        F.when(small, F.col("y")).otherwise(F.col("y") + dy / dist * padding).alias("y"),
    )


