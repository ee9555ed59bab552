"""Similarity fits between reconstructions.

Each fit is one aggregate (means and a 3 x 3 cross-covariance); only those
sixteen numbers reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import vec as V
from ..model import Recon
from .skew import exact_quantiles


@dataclass(frozen=True)
class Similarity:
    """x -> scale * R x + t."""

    rotation: np.ndarray
    translation: np.ndarray
    scale: float = 1.0

    def compose(self, other: "Similarity") -> "Similarity":
        """self after other."""
        return Similarity(
            self.rotation @ other.rotation,
            self.scale * self.rotation @ other.translation + self.translation,
            self.scale * other.scale,
        )

    def inverse(self) -> "Similarity":
        r = self.rotation.T
        return Similarity(r, -(r @ self.translation) / self.scale, 1.0 / self.scale)

    def quaternion(self) -> tuple[float, float, float, float]:
        r = self.rotation
        q = np.empty(4)
        cand = np.array([1 + r[0, 0] + r[1, 1] + r[2, 2], 1 + r[0, 0] - r[1, 1] - r[2, 2],
                         1 - r[0, 0] + r[1, 1] - r[2, 2], 1 - r[0, 0] - r[1, 1] + r[2, 2]])
        k = int(cand.argmax())
        skew = (r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1])
        if k == 0:
            q[:] = (cand[0], *skew)
        else:
            i = k - 1
            q[0] = skew[i]
            for j in range(3):
                q[1 + j] = cand[k] if j == i else r[i, j] + r[j, i]
        q /= np.linalg.norm(q)
        return tuple(float(c) for c in (q if q[0] >= 0 else -q))

    @staticmethod
    def from_axis_angle(axis, angle: float, translation=(0.0, 0.0, 0.0), scale: float = 1.0) -> "Similarity":
        a = np.asarray(axis, float)
        a = a / np.linalg.norm(a)
        k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
        r = np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)
        return Similarity(r, np.asarray(translation, float), float(scale))


def transform_points(df: DataFrame, sim: Similarity, cols=("x", "y", "z"), w: str | None = "w") -> DataFrame:
    """Apply to finite points; rows with w = 0 are directions and only rotate."""
    r = sim.rotation
    v = V.vec(*cols)
    rot = [F.lit(float(r[i, 0])) * v[0] + F.lit(float(r[i, 1])) * v[1] + F.lit(float(r[i, 2])) * v[2] for i in range(3)]
    moved = [F.lit(sim.scale) * rot[i] + F.lit(float(sim.translation[i])) for i in range(3)]
    if w is not None:
        moved = [F.when(F.col(w) == 0.0, rot[i]).otherwise(moved[i]) for i in range(3)]
    return df.withColumns(dict(zip(cols, moved)))


def transform_poses(images: DataFrame, sim: Similarity) -> DataFrame:
    """World-to-camera poses after moving the world: q' = q conj(q_w), t' = -R' C'."""
    qw = tuple(F.lit(c) for c in sim.quaternion())
    q, t = Q.quat("qw", "qx", "qy", "qz"), V.vec("tx", "ty", "tz")
    center = Q.camera_center(q, t)
    moved = V.add(V.scale(Q.rotate(qw, center), F.lit(sim.scale)), V.vec(*[float(c) for c in sim.translation]))
    q2 = Q.mul(q, Q.conj(qw))
    t2 = V.neg(Q.rotate(q2, moved))
    return images.withColumns(dict(zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), (*q2, *t2))))


def transform_recon(recon: Recon, sim: Similarity) -> Recon:
    """Points, normals, patch half-vectors, poses and rig offsets under one similarity."""
    points = transform_points(recon.points, sim)
    for cols, s in ((("nx", "ny", "nz"), 1.0), (("ux", "uy", "uz"), sim.scale), (("vx", "vy", "vz"), sim.scale)):
        if cols[0] in points.columns:
            points = transform_points(points, Similarity(sim.rotation, np.zeros(3), s), cols, w=None)
    out = recon.with_(points=points, images=transform_poses(recon.images, sim))
    if recon.sensors is not None:
        grown = {c: F.col(c) * F.lit(sim.scale) for c in ("tx", "ty", "tz")}
        out = out.with_(sensors=recon.sensors.withColumns(grown))
    return out


def fit_similarity(pairs: DataFrame, estimate_scale: bool = True) -> Similarity:
    """Least-squares similarity over pairs (sx, sy, sz) -> (tx, ty, tz); without scale, a rigid transform.

    Coinciding sources define no scale; it is one then.
    """
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m_{c}") for c in (*s, *t)]
    aggs += [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in t for b in s]
    aggs += [F.var_pop(c).alias(f"v_{c}") for c in s]
    r = pairs.agg(*aggs).first()
    if r["n"] < 3:
        raise ValueError("a similarity needs at least three pairs")
    cov = np.array([[r[f"c_{a}_{b}"] for b in s] for a in t])
    u, d, vt = np.linalg.svd(cov)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rot = u @ flip @ vt
    var = sum(r[f"v_{c}"] for c in s)
    scale = float((d * np.diag(flip)).sum() / var) if estimate_scale and var > 0 else 1.0
    ms, mt = np.array([r[f"m_{c}"] for c in s]), np.array([r[f"m_{c}"] for c in t])
    return Similarity(rot, mt - scale * rot @ ms, scale)


def residuals(pairs: DataFrame, sim: Similarity) -> DataFrame:
    """Adds ``residual``, the distance left after moving the source."""
    r = sim.rotation
    s = V.vec("sx", "sy", "sz")
    moved = [
        F.lit(sim.scale) * V.dot(V.vec(*[float(c) for c in r[i]]), s) + F.lit(float(sim.translation[i])) for i in range(3)
    ]
    return pairs.withColumn("residual", V.norm(V.sub(tuple(moved), V.vec("tx", "ty", "tz"))))


def fit_trimmed(pairs: DataFrame, keep_percentile: float = 90.0, rounds: int = 3) -> Similarity:
    """Refit on the pairs within the residual percentile, a few rounds."""
    sim = fit_similarity(pairs)
    for _ in range(rounds):
        res = residuals(pairs, sim)
        limit = exact_quantiles(res, [], "residual", {"q": keep_percentile / 100.0}).first()["q"]
        sim = fit_similarity(res.filter(F.col("residual") <= limit))
    return sim


def ransac_similarity(pairs: DataFrame, threshold: float, iterations: int = 64, sample: int = 3, seed: int = 0) -> tuple[Similarity, int]:
    """Consensus over hypotheses; all of them are scored in one pass over the pairs.

    Every draw is over all pairs: the row with the smallest hash under the draw's own seed, then the
    smallest ``pair_id``. One pass makes all draws and one scores all hypotheses, in NumPy over batches;
    a task sends one row a draw, and iterations x sample rows reach the driver. Without a usable
    hypothesis every pair counts as an inlier.
    """
    drawn = _draws(pairs, iterations * sample, seed)
    hyps = []
    for i in range(iterations if drawn else 0):
        rows = {drawn[k] for k in range(i * sample, (i + 1) * sample)}
        sim = _local_fit(np.array(sorted(rows), float)) if len(rows) == sample else None
        if sim is not None:
            hyps.append(sim)
    if not hyps:
        return fit_similarity(pairs), pairs.count()
    counts = _scores(pairs, hyps, threshold)
    best = max(range(len(hyps)), key=lambda i: (counts[i], -i))
    inliers = residuals(pairs, hyps[best]).filter(F.col("residual") <= threshold)
    # Fewer inliers than a sample don't define a fit; the hypothesis stands.
    return (fit_similarity(inliers) if counts[best] >= sample else hyps[best]), int(counts[best])


def _draws(pairs: DataFrame, n: int, seed: int) -> list[tuple]:
    """The rows of ``n`` draws in order, none if there are no pairs."""
    cols = ["sx", "sy", "sz", "tx", "ty", "tz"]

    def least(batches):
        best = None
        for b in batches:
            if not len(b):
                continue
            b = b.sort_values("pair_id", kind="stable")
            h = b["_h"].to_numpy().view(np.uint64)
            row, low = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            for k in range(n):
                mixed = _mix(h + _mix(np.uint64(k + 1)))
                row[k] = mixed.argmin()
                low[k] = mixed[row[k]]
            found = b.iloc[row].drop(columns="_h").assign(draw=np.arange(n, dtype=np.int32), low=low.view(np.int64) ^ np.int64(-(2**63)))
            best = found if best is None else pd.concat((best, found)).sort_values(["draw", "low", "pair_id"]).drop_duplicates("draw")
        if best is not None:
            yield best

    hashed = pairs.select("pair_id", *[F.col(c).cast("double").alias(c) for c in cols], F.xxhash64(F.lit(seed), "pair_id").alias("_h"))
    kind = pairs.schema["pair_id"].dataType.simpleString()
    found = hashed.mapInPandas(least, f"pair_id {kind}, " + ", ".join(f"{c} double" for c in cols) + ", draw int, low long")
    rows = found.groupBy("draw").agg(F.min_by(F.struct(*cols), F.struct("low", "pair_id")).alias("r")).orderBy("draw").collect()
    return [tuple(r["r"]) for r in rows]


def _mix(h: np.ndarray) -> np.ndarray:
    """Every draw's order of the same hashes; equal only for equal hashes."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _scores(pairs: DataFrame, hyps: list[Similarity], threshold: float) -> list[int]:
    """Pairs within the threshold of every hypothesis."""
    turns = [(sim.scale * sim.rotation, sim.translation) for sim in hyps]

    def count(batches):
        n = np.zeros(len(turns), np.int64)
        for b in batches:
            s, t = b[["sx", "sy", "sz"]].to_numpy(np.float64), b[["tx", "ty", "tz"]].to_numpy(np.float64)
            for k, (r, o) in enumerate(turns):
                d = s @ r.T + o - t
                n[k] += np.count_nonzero((d * d).sum(1) <= threshold * threshold)
        yield pd.DataFrame({"h": np.arange(len(turns), dtype=np.int32), "n": n})

    rows = pairs.select(*[F.col(c).cast("double").alias(c) for c in ("sx", "sy", "sz", "tx", "ty", "tz")]).mapInPandas(count, "h int, n long")
    total = {r["h"]: r["n"] for r in rows.groupBy("h").agg(F.sum("n").alias("n")).collect()}
    return [total[k] for k in range(len(hyps))]


def _local_fit(rows: np.ndarray) -> Similarity | None:
    s, t = rows[:, :3], rows[:, 3:]
    ms, mt = s.mean(0), t.mean(0)
    var = ((s - ms) ** 2).sum() / len(s)
    if var < 1e-18:
        return None
    u, d, vt = np.linalg.svd((t - mt).T @ (s - ms) / len(s))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rot = u @ flip @ vt
    scale = float((d * np.diag(flip)).sum() / var)
    return Similarity(rot, mt - scale * rot @ ms, scale) if scale > 0 else None
