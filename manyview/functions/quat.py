"""Rotations as (w, x, y, z) tuples of Columns; poses map world to camera."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vec as V

Quat = tuple[Column, Column, Column, Column]


def quat(*names) -> Quat:
    return tuple(F.col(n) if isinstance(n, str) else F.lit(n) for n in names)


def normalize(q: Quat) -> Quat:
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return tuple(c / n for c in q)


def conj(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def mul(a: Quat, b: Quat) -> Quat:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def dot4(a: Quat, b: Quat) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]


def rotate(q: Quat, v: V.Vec) -> V.Vec:
    """R(q) v for a unit quaternion: v + 2 u x (u x v + w v)."""
    u = q[1:]
    t = V.add(V.cross(u, v), V.scale(v, q[0]))
    return V.add(v, V.scale(V.cross(u, t), F.lit(2.0)))


def rotate_inverse(q: Quat, v: V.Vec) -> V.Vec:
    return rotate(conj(q), v)


def matrix(q: Quat) -> tuple[V.Vec, V.Vec, V.Vec]:
    """Rows of the rotation matrix."""
    w, x, y, z = q
    two = F.lit(2.0)
    one = F.lit(1.0)
    return (
        (one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y)),
        (two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x)),
        (two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y)),
    )


def from_matrix(m) -> Quat:
    """Unit quaternion of a rotation matrix given as rows; w >= 0 representative.

    Uses the largest of the four diagonal combinations, so no branch divides by
    a small number.
    """
    (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = m
    one = F.lit(1.0)
    cand = [one + m00 + m11 + m22, one + m00 - m11 - m22, one - m00 + m11 - m22, one - m00 - m11 + m22]
    best = F.greatest(*cand)
    raw = [
        (cand[0], m21 - m12, m02 - m20, m10 - m01),
        (m21 - m12, cand[1], m01 + m10, m02 + m20),
        (m02 - m20, m01 + m10, cand[2], m12 + m21),
        (m10 - m01, m02 + m20, m12 + m21, cand[3]),
    ]
    picked = []
    for c in range(4):
        expr = raw[3][c]
        for r in (2, 1, 0):
            expr = F.when(cand[r] == best, raw[r][c]).otherwise(expr)
        picked.append(expr)
    q = normalize(tuple(picked))
    sign = F.when(q[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(c * sign for c in q)


def from_axis_angle(axis: V.Vec, angle: Column) -> Quat:
    n = V.norm(axis)
    s = F.sin(angle / 2.0) / n
    return (F.cos(angle / 2.0), axis[0] * s, axis[1] * s, axis[2] * s)


def euler(q: Quat) -> V.Vec:
    """(roll, pitch, yaw) of Rz(yaw) Ry(pitch) Rx(roll)."""
    r = matrix(q)
    pitch = -F.asin(V.clamp_cos(r[2][0]))
    return (F.atan2(r[2][1], r[2][2]), pitch, F.atan2(r[1][0], r[0][0]))


def angle(q: Quat) -> Column:
    """Rotation angle in [0, pi]."""
    return 2.0 * F.atan2(V.norm(q[1:]), F.abs(q[0]))


def angle_between(a: Quat, b: Quat) -> Column:
    return angle(mul(b, conj(a)))


def halfway(a: Quat, b: Quat) -> Quat:
    """Spherical interpolation at t = 1/2 along the shorter arc."""
    s = F.when(dot4(a, b) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return normalize(tuple(x + s * y for x, y in zip(a, b)))


def slerp(a: Quat, b: Quat, t: Column) -> Quat:
    s = F.when(dot4(a, b) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    d = V.clamp_cos(dot4(a, b) * s)
    th = F.acos(d)
    sin_th = F.sin(th)
    flat = sin_th < 1e-12
    wa = F.when(flat, 1.0 - t).otherwise(F.sin((1.0 - t) * th) / sin_th)
    wb = F.when(flat, t).otherwise(F.sin(t * th) / sin_th) * s
    return normalize(tuple(x * wa + y * wb for x, y in zip(a, b)))


def camera_center(q: Quat, t: V.Vec) -> V.Vec:
    """C = -R^T t."""
    return V.neg(rotate_inverse(q, t))


def view_direction(q: Quat) -> V.Vec:
    """World direction of the camera's -Z axis."""
    r = matrix(q)
    return V.neg(r[2])


def to_camera(q: Quat, t: V.Vec, p: V.Vec) -> V.Vec:
    return V.add(rotate(q, p), t)
