"""Triangle and angle formulas as column expressions; points are pairs of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def side(p: Point, q: Point) -> Column:
    return F.hypot(p[0] - q[0], p[1] - q[1])


def _angle(opposite: Column, b: Column, c: Column) -> Column:
    cosine = (b * b + c * c - opposite * opposite) / (2 * b * c)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def interior_angles(p: Point, q: Point, r: Point) -> Column:
    """The three interior angles in degrees, ascending; zeros where a side has no length."""
    a, b, c = side(q, r), side(p, r), side(p, q)
    first, second = _angle(a, b, c), _angle(b, a, c)
    return F.when((a * b * c) == 0, F.array(*[F.lit(0.0)] * 3)).otherwise(F.array_sort(F.array(first, second, 180 - first - second)))


def opening_angle(before: Point, at: Point, after: Point) -> Column:
    """min(360 - interior, 180) at a vertex of a counter-clockwise loop."""
    to = lambda p: F.degrees(F.atan2(p[1] - at[1], p[0] - at[0]))
    interior = F.pmod(to(before) - to(after), F.lit(360.0))
    return F.least(360 - interior, F.lit(180.0))


def descriptor(angles: Column, openings: list[Column]) -> Column:
    """[two smallest interior angles, three opening angles ascending] in single precision."""
    return F.concat(F.slice(angles, 1, 2), F.array_sort(F.array(*openings))).cast("array<float>")


def shape_features(p: Point, q: Point, r: Point, eps: float = 1e-8) -> dict[str, Column]:
    """Ratios of the sorted sides, inradius over circumradius / 2 by Heron's formula, elongation."""
    a, b, c = side(q, r), side(p, r), side(p, q)
    s = F.array_sort(F.array(a, b, c))
    s0, s1, s2 = s[0], s[1], s[2]
    half = (a + b + c) / 2
    area2 = F.greatest(F.lit(0.0), half * (half - a) * (half - b) * (half - c))
    return {"ratio_01": s0 / (s1 + eps), "ratio_12": s1 / (s2 + eps), "ratio_02": s0 / (s2 + eps), "radius_ratio": 4 * area2 / (half * a * b * c + eps), "elongation": s2 / (s0 + eps)}


def centroid(p: Point, q: Point, r: Point, offset: Point | None = None) -> Point:
    x, y = (p[0] + q[0] + r[0]) / 3, (p[1] + q[1] + r[1]) / 3
    return (x + offset[0], y + offset[1]) if offset else (x, y)


def outward_bisector(before, at, after) -> tuple[Column, Column]:
    """Unit vector that halves the outer angle of a counter-clockwise boundary at a vertex; where the sides fold back on
    each other, the normal of the first."""

    def normal(p, q):
        dx, dy = q[0] - p[0], q[1] - p[1]
        size = F.hypot(dx, dy) + 1e-10
        return dy / size, -dx / size

    (ax, ay), (bx, by) = normal(before, at), normal(at, after)
    length = F.hypot(ax + bx, ay + by)
    return F.when(length < 1e-6, ax).otherwise((ax + bx) / length), F.when(length < 1e-6, ay).otherwise((ay + by) / length)


def adaptive_tolerance(area: Column, image_area: Column, perimeter: Column) -> Column:
    """Tolerance for simplification, growing with the root of the share of the image: 0.2 to 2 % of the perimeter."""
    return (0.002 + 0.018 * F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), area / image_area)))) * perimeter
