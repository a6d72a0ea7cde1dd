"""Points that cannot be on a hull, found with built-in aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import stage

#: Directions in which the farthest point of a group is looked for.
DIRECTIONS = 16

#: How far inside a point has to be, as a share of the squared size of its group, so that rounding never removes a vertex.
MARGIN = 1e-12


def _farthest(k: int) -> Column:
    angle = 2 * math.pi * k / DIRECTIONS
    reach = F.col("x") * math.cos(angle) + F.col("y") * math.sin(angle)
    return F.max_by(F.struct("x", "y"), F.struct(reach.alias("r"), F.col("x").alias("x"), F.col("y").alias("y"))).alias(f"_p{k}")


def outer_points(points: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group, x, y)``: the points of each group that are not inside the polygon of its farthest points.

    The farthest points in fixed directions are vertices of the hull, so what lies strictly inside their polygon
    is none.  They are found by partial aggregates of constant size, one shuffled row per group and task, and
    the test of a point is a few products; both stay in generated code.  Coordinates are finite doubles.
    """
    group = list(group)
    size = [F.pow(F.max(c) - F.min(c), 2) for c in ("x", "y")]
    polygons = points.groupBy(*group).agg(*(_farthest(k) for k in range(DIRECTIONS)), (size[0] + size[1]).alias("_size"))
    # Groups with a null in their key are met by a key of their own that is never null.
    key = F.xxhash64(*group).alias("_key")
    polygons = stage(polygons.select(key, *(F.col(c).alias(f"_g_{c}") for c in group), *(f"_p{k}" for k in range(DIRECTIONS)), "_size"), "extremes")

    def apart(a: Column, b: Column) -> Column:
        return (a["x"] != b["x"]) | (a["y"] != b["y"])

    def left_of(a: Column, b: Column) -> Column:
        cross = (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"])
        return cross > F.col("_size") * MARGIN

    corners = [F.col(f"_p{k}") for k in range(DIRECTIONS)]
    sides = list(zip(corners, [*corners[1:], corners[0]]))
    inside = reduce(Column.__and__, (~apart(a, b) | left_of(a, b) for a, b in sides))
    solid = reduce(Column.__or__, (apart(a, b) for a, b in sides))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group))
    met = points.withColumn("_key", F.xxhash64(*group)).join(polygons, "_key").filter(same)
    return met.filter(~(solid & inside)).select(*group, "x", "y")
