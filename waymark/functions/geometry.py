"""Column expressions of plane geometry: x to the right, z down, angles in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TAU = math.pi, 2 * math.pi


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def distance(x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (z2 - z1) * (z2 - z1))


def bearing(x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    return F.atan2(z2 - z1, x2 - x1)


def signed_angle(a: Column, b: Column) -> Column:
    """b - a, folded once into -pi to pi with a truncated remainder."""
    d = (b - a + PI) % F.lit(TAU) - PI
    return F.when(d < -PI, d + TAU).otherwise(d)


def angle_diff(a: Column, b: Column) -> Column:
    """Signed a - b: an exactly opposite heading gives -pi."""
    return signed_angle(b, a)


def projection(px: Column, pz: Column, x1: Column, z1: Column, x2: Column, z2: Column) -> tuple[Column, Column]:
    """(lateral distance, offset along the segment) of a point; a degenerate segment projects to its start."""
    dx, dz = x2 - x1, z2 - z1
    length2 = dx * dx + dz * dz
    t = F.when(length2 > 0, clamp(((px - x1) * dx + (pz - z1) * dz) / length2, 0.0, 1.0)).otherwise(0.0)
    return distance(px, pz, x1 + t * dx, z1 + t * dz), t * F.sqrt(length2)


def in_circle(px: Column, pz: Column, radius: float, minx: Column, minz: Column, maxx: Column, maxz: Column) -> Column:
    """Whether a box reaches into a circle."""
    dx, dz = px - F.greatest(minx, F.least(px, maxx)), pz - F.greatest(minz, F.least(pz, maxz))
    return dx * dx + dz * dz <= radius * radius


def polyline_length(points: Column) -> Column:
    """Length of an array of structs (x, z)."""
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: distance(a["x"], a["z"], b["x"], b["z"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d))


def quaternion_yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2.0 * (w * y - x * z), 1.0 - 2.0 * (y * y + z * z))


def turn_of_angle(angle: Column) -> Column:
    """Turn class of a signed angle, positive to the right."""
    a, side = F.abs(angle), F.when(angle > 0, "Right").otherwise("Left")
    return F.when(a < 0.7, F.concat(F.lit("Slight"), side)).when(a < 1.6, side).when(a < 2.6, F.concat(F.lit("Sharp"), side)).otherwise("UTurn")


def turn_angle(before: Column, after: Column) -> Column:
    """after - before by a truncated remainder, folded into -pi to pi at both ends; positive to the right."""
    d = (after - before) % F.lit(TAU)
    return F.when(d > PI, d - TAU).when(d < -PI, d + TAU).otherwise(d)


def edge_length(points: Column, x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    """Length along the points, or between the ends where there are fewer than two."""
    return F.when(F.size(points) >= 2, polyline_length(points)).otherwise(distance(x1, z1, x2, z2))


def entry_tangent(points: Column, x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    """Direction of the first segment, or between the ends."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    return F.when(F.size(points) >= 2, bearing(a["x"], a["z"], b["x"], b["z"])).otherwise(bearing(x1, z1, x2, z2))


def exit_tangent(points: Column, x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    """Direction of the last segment, or between the ends."""
    a, b = F.get(points, F.size(points) - 2), F.get(points, F.size(points) - 1)
    return F.when(F.size(points) >= 2, bearing(a["x"], a["z"], b["x"], b["z"])).otherwise(bearing(x1, z1, x2, z2))
