"""3-vectors as triples of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names) -> Vec:
    return tuple(F.col(n) if isinstance(n, str) else F.lit(n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, s) -> Vec:
    return tuple(x * s for x in a)


def neg(a: Vec) -> Vec:
    return tuple(-x for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def clamp_cos(c: Column) -> Column:
    """Clamp a cosine to [-1, 1] before ``acos``."""
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Squared L2 distance of two array columns, summed in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d * d)


def sorted_median(sorted_array: Column) -> Column:
    """Median of a short, ascending, null-free array column (NULL when empty)."""
    n = F.size(sorted_array)
    hi = F.element_at(sorted_array, F.greatest((n / 2).cast("int") + 1, F.lit(1)))
    lo = F.element_at(sorted_array, F.greatest(((n + 1) / 2).cast("int"), F.lit(1)))
    return F.when(n > 0, (lo + hi) / 2.0)
