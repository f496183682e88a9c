"""Column expressions of analytic geometry; every function works on columns or names of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add as plus

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def columns(names: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def total(parts: Sequence[Column]) -> Column:
    return reduce(plus, parts)


def dot(v: Vector, w: Vector) -> Column:
    return total([a * b for a, b in zip(v, w, strict=True)])


def squared(v: Vector) -> Column:
    return dot(v, v)


def length(v: Vector) -> Column:
    return F.sqrt(squared(v))


def vector(start: Vector, stop: Vector) -> list[Column]:
    return [b - a for a, b in zip(start, stop, strict=True)]


def scale(v: Vector, by: Column | float) -> list[Column]:
    return [a * by for a in v]


def add(v: Vector, w: Vector) -> list[Column]:
    return [a + b for a, b in zip(v, w, strict=True)]


def unit(v: Vector) -> list[Column]:
    """v over its length; null for the zero vector."""
    size = length(v)
    return [F.when(size > 0, a / size) for a in v]


def squared_distance(v: Vector, w: Vector) -> Column:
    return squared(vector(v, w))


def distance(v: Vector, w: Vector) -> Column:
    return F.sqrt(squared_distance(v, w))


def on_segment(point: Vector, start: Vector, stop: Vector) -> Column:
    """Place of the nearest point of a segment, from 0 at start to 1 at stop; 0 on a segment without length."""
    line = vector(start, stop)
    size = squared(line)
    t = F.when(size > 0, dot(vector(start, point), line) / size).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def foot_on_segment(point: Vector, start: Vector, stop: Vector) -> list[Column]:
    return add(scale(vector(start, stop), on_segment(point, start, stop)), start)


def segment_distance(point: Vector, start: Vector, stop: Vector) -> Column:
    return distance(point, foot_on_segment(point, start, stop))


def spherical_pdf(d2: Column, variance: Column, dims: int) -> Column:
    """Density of a Gaussian of equal variance in each dimension, at squared distance d2 of its centre."""
    return F.pow(2 * math.pi * variance, F.lit(-dims / 2)) * F.exp(-d2 / (2 * variance))


def log_spherical_pdf(d2: Column, variance: Column, dims: int) -> Column:
    return -(dims * F.log(2 * math.pi * variance) + d2 / variance) / 2


def eigenvalues_2d(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues of [[a, c], [c, b]], the larger first."""
    middle, half = (a + b) / 2, F.sqrt(F.pow((a - b) / 2, 2) + c * c)
    return middle + half, middle - half


def eigenvalues_3d(a: Column, b: Column, c: Column, ab: Column, ac: Column, bc: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of the symmetric matrix with diagonal a, b, c, in falling order; three times the mean when all are equal."""
    mean = (a + b + c) / 3
    u, v, w = a - mean, b - mean, c - mean
    p = F.sqrt((u * u + v * v + w * w + 2 * (ab * ab + ac * ac + bc * bc)) / 6)
    determinant = u * v * w + 2 * ab * bc * ac - ac * ac * v - ab * ab * w - bc * bc * u
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), determinant / (2 * F.pow(p, 3))))
    angle = F.acos(r) / 3
    first = mean + 2 * p * F.cos(angle)
    last = mean + 2 * p * F.cos(angle + 2 * math.pi / 3)
    flat = p == 0
    return (F.when(flat, mean).otherwise(first), F.when(flat, mean).otherwise(3 * mean - first - last), F.when(flat, mean).otherwise(last))


def ellipse_2d(a: Column, b: Column, c: Column, share: float) -> tuple[Column, Column, Column]:
    """Half axes and angle (of the longer one, radians) of the ellipse that holds a share of a Gaussian with covariance [[a, c], [c, b]]."""
    large, small = eigenvalues_2d(a, b, c)
    spread = -2 * math.log(1 - share)
    return F.sqrt(spread * large), F.sqrt(spread * F.greatest(small, F.lit(0.0))), F.atan2(large - a, c)


def short_number(x: Column, digits: int = 2) -> Column:
    """A number as text with at most `digits` decimals."""
    return F.round(x, digits).cast("string")
