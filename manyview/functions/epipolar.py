"""Two-view geometry as Column expressions; matrices are rows of triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import quat as Q
from . import vec as V

Mat = tuple[V.Vec, V.Vec, V.Vec]


def relative(qa: Q.Quat, ta: V.Vec, qb: Q.Quat, tb: V.Vec) -> tuple[Q.Quat, V.Vec]:
    """Pose taking camera a coordinates to camera b coordinates."""
    q = Q.mul(qb, Q.conj(qa))
    return q, V.sub(tb, Q.rotate(q, ta))


def essential(q: Q.Quat, t: V.Vec) -> Mat:
    """[t]x R."""
    r = Q.matrix(q)
    return tuple(
        tuple(c)
        for c in (
            [t[1] * r[2][k] - t[2] * r[1][k] for k in range(3)],
            [t[2] * r[0][k] - t[0] * r[2][k] for k in range(3)],
            [t[0] * r[1][k] - t[1] * r[0][k] for k in range(3)],
        )
    )


def inverse_intrinsics(m: Mat, ka: dict[str, Column], kb: dict[str, Column]) -> Mat:
    """K_b^-T M K_a^-1 for intrinsics without skew."""
    rows = [
        tuple(c / kb["fx"] for c in m[0]),
        tuple(c / kb["fy"] for c in m[1]),
    ]
    rows.append(tuple(m[2][k] - kb["cx"] * rows[0][k] - kb["cy"] * rows[1][k] for k in range(3)))
    out = []
    for r in rows:
        a, b = r[0] / ka["fx"], r[1] / ka["fy"]
        out.append((a, b, r[2] - ka["cx"] * a - ka["cy"] * b))
    return tuple(out)


def epipole(f: Mat) -> tuple[V.Vec, V.Vec]:
    """Left and right null directions of a rank-2 matrix, as the best conditioned row or column cross product."""
    cols = tuple(tuple(f[r][c] for r in range(3)) for c in range(3))
    return _null(cols), _null(f)


def _null(rows) -> V.Vec:
    cand = [V.cross(rows[0], rows[1]), V.cross(rows[0], rows[2]), V.cross(rows[1], rows[2])]
    size = [V.dot(c, c) for c in cand]
    top = F.greatest(*size)
    return tuple(
        F.when(size[0] == top, cand[0][k]).when(size[1] == top, cand[1][k]).otherwise(cand[2][k]) for k in range(3)
    )
