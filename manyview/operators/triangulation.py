"""Batch triangulation and depth uncertainty from per-track sums.

Rays never travel as groups: six matrix sums and three right-hand sums per track
are ordinary aggregates, and only the 3 x 3 solve runs in an Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V

EIGEN_REL_TOL = 1e-12
UPPER = (("00", 0, 0), ("01", 0, 1), ("02", 0, 2), ("11", 1, 1), ("12", 1, 2), ("22", 2, 2))

SOLUTION = T.StructType([T.StructField(c, T.DoubleType()) for c in ("px", "py", "pz", "l0", "l1", "l2", "cond")])


def _sym(m: list[np.ndarray]) -> np.ndarray:
    a = np.empty((len(m[0]), 3, 3))
    for (_, i, j), c in zip(UPPER, m):
        a[:, i, j] = c
        a[:, j, i] = c
    return a


@F.pandas_udf(SOLUTION)
def solve_normal(
    a00: pd.Series, a01: pd.Series, a02: pd.Series, a11: pd.Series, a12: pd.Series, a22: pd.Series,
    b0: pd.Series, b1: pd.Series, b2: pd.Series,
) -> pd.DataFrame:
    """Minimum-norm solution, ascending spectrum and condition number of A p = b."""
    cols = [s.to_numpy(dtype=np.float64) for s in (a00, a01, a02, a11, a12, a22)]
    b = np.stack([s.to_numpy(dtype=np.float64) for s in (b0, b1, b2)], axis=1)
    lam, vec = np.linalg.eigh(_sym(cols))
    usable = lam > (np.maximum(lam[:, 2:], 0.0) * EIGEN_REL_TOL)
    coef = np.einsum("nij,ni->nj", vec, b)
    coef = np.where(usable, coef / np.where(usable, lam, 1.0), 0.0)
    p = np.einsum("nij,nj->ni", vec, coef)
    lam = np.maximum(lam, 0.0)
    cond = np.where(lam[:, 0] > 0, lam[:, 2] / np.where(lam[:, 0] > 0, lam[:, 0], 1.0), np.inf)
    return pd.DataFrame(np.column_stack([p, lam, cond]), columns=["px", "py", "pz", "l0", "l1", "l2", "cond"])


def _projector(d: V.Vec) -> list:
    one = lambda i, j: F.lit(1.0 if i == j else 0.0)
    return [(one(i, j) - d[i] * d[j]) for _, i, j in UPPER]


def triangulate(rays: DataFrame, key: str = "track") -> DataFrame:
    """rays (track, dx, dy, dz, cx, cy, cz) to (track, n, px, py, pz, l0, l1, l2, cond, in_front)."""
    d, c = V.vec("dx", "dy", "dz"), V.vec("cx", "cy", "cz")
    proj = _projector(d)
    cd = V.dot(c, d)
    rhs = [c[i] - cd * d[i] for i in range(3)]
    sums = rays.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(e).alias(f"a{n}") for (n, _, _), e in zip(UPPER, proj)],
        *[F.sum(e).alias(f"b{i}") for i, e in enumerate(rhs)],
    )
    solved = sums.withColumn("s", solve_normal(*[f"a{n}" for n, _, _ in UPPER], "b0", "b1", "b2")).select(key, "n", "s.*")
    p = V.vec("px", "py", "pz")
    ahead = V.dot(V.sub(p, c), d)
    front = rays.join(solved.select(key, "px", "py", "pz"), key).groupBy(key).agg((F.min(ahead) > 0).alias("in_front"))
    return solved.join(front, key)


@F.pandas_udf(T.DoubleType())
def variance_along(
    a00: pd.Series, a01: pd.Series, a02: pd.Series, a11: pd.Series, a12: pd.Series, a22: pd.Series,
    mx: pd.Series, my: pd.Series, mz: pd.Series,
) -> pd.Series:
    """m^T M^-1 m with unobservable directions giving infinity."""
    cols = [s.to_numpy(dtype=np.float64) for s in (a00, a01, a02, a11, a12, a22)]
    m = np.stack([s.to_numpy(dtype=np.float64) for s in (mx, my, mz)], axis=1)
    lam, vec = np.linalg.eigh(_sym(cols))
    tol = np.maximum(lam.max(axis=1, keepdims=True), 0.0) * EIGEN_REL_TOL
    part = np.einsum("nij,ni->nj", vec, m) ** 2
    usable = lam > tol
    var = np.where(usable, part / np.where(usable, lam, 1.0), 0.0).sum(1)
    return pd.Series(np.where(((~usable) & (part > 1e-18)).any(1), np.inf, var))


def _bearing() -> list:
    """Mean direction of summed rays (sdx, sdy, sdz); where they cancel, the first ray's, the
    one from the smallest camera centre."""
    norm = V.norm(V.vec("sdx", "sdy", "sdz"))
    return [F.when(norm > 0, F.col(f"s{a}") / norm).otherwise(F.col(f"_first.{a}")) for a in ("dx", "dy", "dz")]


def depth_uncertainty(rays: DataFrame, solved: DataFrame, sigma: str = "sigma", key: str = "track") -> DataFrame:
    """Depth along the mean ray, its sigma, inverse-depth z and resolvable distance per track."""
    d, c, p = V.vec("dx", "dy", "dz"), V.vec("cx", "cy", "cz"), V.vec("px", "py", "pz")
    mean = rays.groupBy(key).agg(
        *[F.sum(a).alias(f"s{a}") for a in ("dx", "dy", "dz")], *[F.avg(a).alias(f"m{a}") for a in ("cx", "cy", "cz")],
        F.min(F.struct("cx", "cy", "cz", "dx", "dy", "dz")).alias("_first"),
    )
    bearing = _bearing()
    mean = mean.select(key, *[e.alias(f"m{a}") for a, e in zip(("dx", "dy", "dz"), bearing, strict=True)], "mcx", "mcy", "mcz")
    j = rays.join(solved.select(key, "px", "py", "pz"), key).join(mean, key)
    rho = V.norm(V.sub(p, c)) * F.col(sigma)
    w = F.when(rho > 0, 1.0 / (rho * rho)).otherwise(F.lit(0.0))
    m = V.vec("mdx", "mdy", "mdz")
    off = V.sub(c, V.vec("mcx", "mcy", "mcz"))
    along = V.dot(off, m)
    perp2 = V.dot(off, off) - along * along
    agg = j.groupBy(key).agg(
        *[F.sum(w * e).alias(f"a{n}") for (n, _, _), e in zip(UPPER, _projector(d))],
        F.avg(F.greatest(perp2, F.lit(0.0))).alias("perp2"), F.avg(F.col(sigma) * F.col(sigma)).alias("sig2"),
    )
    out = agg.join(solved.select(key, "px", "py", "pz"), key).join(mean, key)
    out = out.withColumn("var", variance_along(*[f"a{n}" for n, _, _ in UPPER], "mdx", "mdy", "mdz"))
    depth = V.dot(V.sub(p, V.vec("mcx", "mcy", "mcz")), m)
    s = F.sqrt("var")
    inf = F.lit(float("inf"))
    z = F.when((s > 0) & (s < inf), depth / s).when(s == 0, inf).otherwise(F.lit(0.0))
    reach = F.when(F.col("sig2") > 0, 2.0 * F.sqrt("perp2") / F.sqrt("sig2")).otherwise(inf)
    return out.select(key, depth.alias("depth"), s.alias("depth_sigma"), z.alias("inverse_depth_z"), reach.alias("resolvable_distance"))


#: Solves conditioned better than this are finite without a noise test; z-scores
#: of the inverse depth below the cutoff can't be told from infinity.
WELL_CONDITIONED = 1e4
Z_CUTOFF = 4.0


def classify_infinity(rays: DataFrame, horizon: float, sigma: str = "sigma", z_cutoff: float = Z_CUTOFF, key: str = "track") -> DataFrame:
    """Tracks of two rays or more as finite, infinity or indeterminate: (track, n, class, x, y, z, w).

    A well-conditioned solve in front of all cameras is finite. Otherwise a baseline that
    can't resolve a point at ``horizon`` leaves it open, and a solve that is degenerate, behind
    or too uncertain puts the track at infinity, in the direction of its mean ray (w = 0).
    """
    solved = triangulate(rays, key).filter("n >= 2")
    unsure = depth_uncertainty(rays, solved, sigma, key)
    sums = rays.groupBy(key).agg(*[F.sum(a).alias(f"s{a}") for a in ("dx", "dy", "dz")], F.min(F.struct("cx", "cy", "cz", "dx", "dy", "dz")).alias("_first"))
    bearing = sums.select(key, *[e.alias(f"b{a}") for a, e in zip("xyz", _bearing(), strict=True)])
    inf = float("inf")
    sound = F.col("in_front") & (F.col("cond") < inf)
    for p in ("px", "py", "pz"):
        sound = sound & ~F.isnan(p) & (F.abs(p) < inf)
    kind = (
        F.when(sound & (F.col("cond") < WELL_CONDITIONED), "finite")
        .when(F.col("resolvable_distance") < horizon, "indeterminate")
        .when(~sound | (F.col("inverse_depth_z") < z_cutoff), "infinity")
        .otherwise("finite")
    )
    out = solved.join(unsure, key).join(bearing, key).withColumn("class", kind)
    at = [F.when(F.col("class") == "infinity", F.col(f"b{a}")).otherwise(F.col(f"p{a}")).alias(a) for a in "xyz"]
    return out.select(key, "n", "class", *at, F.when(F.col("class") == "infinity", 0.0).otherwise(1.0).alias("w"))
