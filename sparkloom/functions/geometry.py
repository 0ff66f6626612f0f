"""Scalar functions on angles, boxes, cameras and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight directions from 0 degrees on, and the upper edges of all but the last; those of the four main directions belong to them.
DIRECTIONS = ("front", "front-right", "right", "behind-right", "behind", "behind-left", "left", "front-left")
EDGES = (22.5, 67.5, 112.5, 157.5, 202.5, 247.5, 292.5)


def angle_bucket(angle: Column) -> Column:
    """The direction of an angle in degrees: 0 is front, 90 is right."""
    a = F.pmod(angle, F.lit(360.0))
    steps = [F.when(a <= edge if k % 2 == 0 else a < edge, name) for k, (edge, name) in enumerate(zip(EDGES, DIRECTIONS))]
    return F.coalesce(F.when(a >= 337.5, DIRECTIONS[0]), *steps, F.lit(DIRECTIONS[-1]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def camera_angle(matrix: Column, point: Column) -> Column:
    """Degrees of a world point seen by a camera with a 4x4 world-to-camera matrix, clockwise from straight ahead."""
    row = lambda i: dot(F.get(matrix, F.lit(i)), F.concat(point, F.array(F.lit(1.0))))
    return F.pmod(F.degrees(F.atan2(row(0), -row(2))) + 360, F.lit(360.0))


# Labels of a box centre and the upper edges of all but the last.
ACROSS, ACROSS_EDGES = ("left edge", "centre-left", "centre", "centre-right", "right edge"), (0.15, 0.40, 0.60, 0.85)
DOWN, DOWN_EDGES = ("upper", "mid", "lower"), (0.33, 0.66)


def _label(x: Column, names: tuple[str, ...], edges: tuple[float, ...]) -> Column:
    return F.coalesce(*(F.when(x < edge, name) for edge, name in zip(edges, names)), F.lit(names[-1]))


def box_placement(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Label of a box with coordinates from 0 to 1, the origin at the top left."""
    return F.concat(_label(F.lit(0.5) * (y1 + y2), DOWN, DOWN_EDGES), F.lit(" "), _label(F.lit(0.5) * (x1 + x2), ACROSS, ACROSS_EDGES))


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def box_to_pixels(box: list[Column], height: Column, width: Column) -> list[Column]:
    """left, top, right, bottom in pixels of a box with coordinates from 0 to 1 whose origin is at the bottom left."""
    within = lambda x, size: F.greatest(F.lit(0.0), F.least(size - 1.0, x))
    x1, y1, x2, y2 = box
    return [within(x1 * width, width), within(height - y2 * height, height), within(x2 * width, width), within(height - y1 * height, height)]


def point_in_box(x: Column, y: Column, box: list[Column]) -> Column:
    """Whether a point lies in a box of pixels, with a twentieth of its size as tolerance."""
    x1, y1, x2, y2 = box
    inside = lambda p, low, high: ((p - low) / F.greatest(F.lit(1.0), high - low)).between(-0.05, 1.05)
    return inside(x, x1, x2) & inside(y, y1, y2)


def psnr(a: Column, b: Column) -> Column:
    """Peak signal to noise of two arrays of 0 to 1, infinite if equal."""
    error = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    return F.when(error == 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(1.0) / F.when(error == 0, 1.0).otherwise(error)))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two arrays of 0 to 1, from means, variances and covariance over the whole arrays."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y) / F.size(x)
    both = lambda x, u, y, v: mean(F.zip_with(x, y, lambda p, q: (p - u) * (q - v)))
    c1, c2 = 0.01**2, 0.03**2

    def value(m: Column) -> Column:
        u, v = m["u"], m["v"]
        return (u * v * 2 + c1) * (both(a, u, b, v) * 2 + c2) / ((u * u + v * v + c1) * (both(a, u, a, u) + both(b, v, b, v) + c2))

    return F.get(F.transform(F.array(F.struct(mean(a).alias("u"), mean(b).alias("v"))), value), F.lit(0))  # means are computed once


def loss_weight(n: Column, kind: str) -> Column:
    return {"square": F.lit(1.0) / F.sqrt(n), "token": F.lit(1.0) + n * 0, "sample": F.lit(1.0) / n}[kind]


def curriculum(step: Column, start: float, end: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - start) / (end - start)))
