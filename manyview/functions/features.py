"""Local feature and patch shape expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vec as V


def size(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    """Mean column norm of the 2 x 2 shape."""
    return 0.5 * (F.sqrt(a11 * a11 + a21 * a21) + F.sqrt(a12 * a12 + a22 * a22))


def orientation(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    return F.atan2(a21, a11)


def patch_normal(u: V.Vec, v: V.Vec) -> V.Vec:
    """Unit normal of the patch spanned by two half-vectors."""
    n = V.cross(u, v)
    length = V.norm(n)
    return tuple(c / length for c in n)


def patch_point(center: V.Vec, u: V.Vec, v: V.Vec, s: Column, t: Column) -> V.Vec:
    """World position of patch coordinates in [-1, 1]."""
    return V.add(center, V.add(V.scale(u, s), V.scale(v, t)))


def front_facing(center: V.Vec, normal: V.Vec, camera: V.Vec) -> Column:
    return V.dot(normal, V.sub(camera, center)) > 0
