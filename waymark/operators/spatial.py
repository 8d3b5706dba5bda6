"""Spatial joins of points with edges by an equality join on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import angle_diff, bearing, clamp, in_circle, projection

#: A power of two, so that dividing by it is exact.
CELL = 256.0


def cell(value: Column, size: float = CELL) -> Column:
    return F.floor(value / size).cast("long")


def _cells(lo_x: Column, hi_x: Column, lo_z: Column, hi_z: Column, size: float) -> Column:
    """Array of (cx, cz) that a box touches."""
    xs, zs = F.sequence(cell(lo_x, size), cell(hi_x, size)), F.sequence(cell(lo_z, size), cell(hi_z, size))
    return F.flatten(F.transform(xs, lambda cx: F.transform(zs, lambda cz: F.struct(cx.alias("cx"), cz.alias("cz")))))


def radius_join(points: DataFrame, edges: DataFrame, radius: float, key: str, size: float = CELL) -> DataFrame:
    """Pairs of points (key, x, z) and edges (edge_id, x1, z1, x2, z2) whose box reaches into the circle, once each.

    Edges are listed under each cell they touch, points under each cell of their circle; a pair counts in the first
    cell that both share, so no distinct is needed.
    """
    box = edges.withColumns({"minx": F.least("x1", "x2"), "maxx": F.greatest("x1", "x2"), "minz": F.least("z1", "z2"), "maxz": F.greatest("z1", "z2")})
    box = box.withColumn("c", F.explode(_cells(F.col("minx"), F.col("maxx"), F.col("minz"), F.col("maxz"), size))).select("*", "c.cx", "c.cz").drop("c")
    x, z = F.col("x"), F.col("z")
    near = points.withColumn("c", F.explode(_cells(x - radius, x + radius, z - radius, z + radius, size))).select("*", "c.cx", "c.cz").drop("c")
    pairs = near.join(box, ["cx", "cz"]).where(in_circle(x, z, radius, F.col("minx"), F.col("minz"), F.col("maxx"), F.col("maxz")))
    first = (F.col("cx") == F.greatest(cell(F.col("minx"), size), cell(x - radius, size))) & (F.col("cz") == F.greatest(cell(F.col("minz"), size), cell(z - radius, size)))
    return pairs.where(first).drop("cx", "cz", "minx", "maxx", "minz", "maxz")


def first_scanned(radius: float, size: float = CELL) -> list[Column]:
    """The first cell of an edge that a scan of the query's window (the circle's box and a cell around) meets."""
    out = []
    for p, a, b in (("x", "x1", "x2"), ("z", "z1", "z2")):
        out.append(F.greatest(cell(F.least(a, b), size), cell(F.col(p) - radius, size) - 1))
    return out


def with_projection(pairs: DataFrame) -> DataFrame:
    lateral, offset = projection(*(F.col(c) for c in ("x", "z", "x1", "z1", "x2", "z2")))
    return pairs.withColumns({"lateral": lateral, "offset": offset})


def nearest_edge(points: DataFrame, edges: DataFrame, radius: float, key: str) -> DataFrame:
    """The nearest routable edge of each point within a radius; ties go to the edge scanned first, then the smaller id."""
    pairs = with_projection(radius_join(points, edges.where("kind in (0, 1)"), radius, key)).where(F.col("lateral") <= radius)
    order = Window.partitionBy(key).orderBy(F.round("lateral", 9), *first_scanned(radius), "edge_id")
    return pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def match_score(lateral: Column, heading: Column, tangent: Column, topology: Column, scale: float = 20.0, heading_scale: float = math.pi / 2) -> Column:
    """0.5 for closeness, 0.3 for heading (opposite headings forgiven if the signed difference is positive), 0.2 for topology."""
    d = angle_diff(heading, tangent)
    turned = F.abs(F.least(d, F.lit(math.pi) - d))
    return 0.5 * clamp(1.0 - lateral / scale, 0.0, 1.0) + 0.3 * clamp(1.0 - turned / heading_scale, 0.0, 1.0) + 0.2 * topology


def candidates(points: DataFrame, edges: DataFrame, radius: float, key: str, k: int = 8, scale: float = 20.0) -> DataFrame:
    """The k best scored candidate edges of each point (with heading) that has not been matched before."""
    # an edge's box is no farther than the edge
    pairs = with_projection(radius_join(points, edges.where("kind in (0, 1)"), min(radius, 3 * scale), key)).where(F.col("lateral") <= 3 * scale)
    score = match_score(F.col("lateral"), F.col("heading"), bearing(*(F.col(c) for c in ("x1", "z1", "x2", "z2"))), F.lit(0.5), scale)
    order = Window.partitionBy(key).orderBy(F.desc("score"), *first_scanned(radius), "edge_id")
    return pairs.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
