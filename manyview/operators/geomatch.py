"""Matching of image pairs with known poses.

Features of a pair are put in the order of their epipolar lines and meet the ``window``
targets nearest in that order. The order is the row of the rectified images, or, where an
epipole lies in an image, the angle about the epipoles. A candidate has to fit the pair's
geometry: turned by the relative rotation, the query's shape must point as the target's
does, and where the rays meet at an angle that allows a depth, its size must too.

All pairs of a job are matched at once: pair geometry is a row of columns, features are joined
to it by image, and the sweep works on ranks over range partitions, so neither a large image
nor an image in many pairs lands in one task. Poses are canonical (the camera looks along
-z, y up); everything below is in the optical frame (z forward, y down).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convention, epipolar, features
from ..functions import quat as Q
from ..functions import vec as V
from ..session import cut
from .matching import sweep_candidates

CAMERA = ("fx", "fy", "cx", "cy")
POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
SHAPE = ("a11", "a12", "a21", "a22")
#: A homogeneous third part below this share of the whole is a point at infinity.
AT_INFINITY = 1e-10
#: Directions at which the angle between both images' epipolar lines is taken.
DIRECTIONS = 36


@dataclass(frozen=True)
class ShapeTest:
    """Limits of the candidate test; angles in degrees."""

    max_turn: float = 15.0
    min_ray_angle: float = 5.0
    min_size_ratio: float = 0.8
    max_size_ratio: float = 1.25


def _quat(side: str) -> Q.Quat:
    return Q.quat(*[f"{side}_{c}" for c in POSE[:4]])


def _shift(side: str) -> V.Vec:
    return V.vec(*[f"{side}_{c}" for c in POSE[4:]])


def optical(images: DataFrame) -> DataFrame:
    """Canonical poses as optical ones."""
    q, t = convention.flip_camera(Q.quat(*POSE[:4]), V.vec(*POSE[4:]))
    return images.select("image_id", "camera_id", *[c.alias(n) for c, n in zip((*q, *t), POSE)])


def _pixel(side: str, p: V.Vec) -> V.Vec:
    """Homogeneous pixel of a camera-frame point."""
    k = {c: F.col(f"{side}_{c}") for c in CAMERA}
    return (k["fx"] * p[0] + k["cx"] * p[2], k["fy"] * p[1] + k["cy"] * p[2], p[2])


def _outside(side: str, margin: float) -> Column:
    """The epipole of this image is at infinity or beyond the margin around the image."""
    x, y = F.col(f"{side}_ex"), F.col(f"{side}_ey")
    beyond = (x < -margin) | (x > F.col(f"{side}_width") + margin) | (y < -margin) | (y > F.col(f"{side}_height") + margin)
    return x.isNull() | beyond


def pair_geometry(pairs: DataFrame, images: DataFrame, cameras: DataFrame, margin: float = 50.0) -> DataFrame:
    """pairs (pair, i, j) with the cameras of both sides (a_*, b_*), relative pose, epipoles, ``polar`` and what either
    order needs. cameras (camera_id, width, height, fx, fy, cx, cy).

    Pairs without a baseline or with a focal length of zero have no epipolar lines and are left out.
    """
    posed = optical(images).join(cameras.select("camera_id", "width", "height", *CAMERA), "camera_id").drop("camera_id")
    side = lambda s, key: posed.select(F.col("image_id").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in posed.columns if c != "image_id"])
    both = pairs.select("pair", "i", "j").join(side("a", "i"), "i").join(side("b", "j"), "j")
    q, t = epipolar.relative(_quat("a"), _shift("a"), _quat("b"), _shift("b"))
    rel = both.select("*", *[c.alias(n) for c, n in zip((*q, *t), (f"r_{c}" for c in POSE))])
    rq, rt = _quat("r"), _shift("r")
    usable = (V.dot(rt, rt) > 0) & (F.col("a_fx") * F.col("a_fy") * F.col("b_fx") * F.col("b_fy") != 0)
    rel = rel.filter(usable)
    for s, p in (("a", V.neg(Q.rotate_inverse(rq, rt))), ("b", rt)):
        e = _pixel(s, p)
        finite = F.abs(e[2]) >= AT_INFINITY * V.norm(e)
        rel = rel.select("*", F.when(finite, e[0] / e[2]).alias(f"{s}_ex"), F.when(finite, e[1] / e[2]).alias(f"{s}_ey"))
    safe = _outside("a", margin) & _outside("b", margin)
    rel = rel.withColumn("polar", ~safe & F.col("a_ex").isNotNull() & F.col("b_ex").isNotNull())
    f = epipolar.inverse_intrinsics(
        epipolar.essential(rq, rt), {c: F.col(f"a_{c}") for c in CAMERA}, {c: F.col(f"b_{c}") for c in CAMERA}
    )
    rel = rel.select("*", *[f[r][c].alias(f"f{r}{c}") for r in range(2) for c in range(2)])
    rel = rel.withColumn("turn", _angle_offset())
    return cut(_rectified(rel))


def _wrapped(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def _angle_offset() -> Column:
    """Median turn from a direction about the first epipole to its line's direction about the second."""

    def turn(n: Column) -> Column:
        theta = n * (2 * math.pi / DIRECTIONS) - math.pi
        a = F.col("f00") * F.cos(theta) + F.col("f01") * F.sin(theta)
        b = F.col("f10") * F.cos(theta) + F.col("f11") * F.sin(theta)
        there = _wrapped(F.atan2(a, -b) - theta)
        return F.when(F.abs(there) > math.pi / 2, _wrapped(F.atan2(-a, b) - theta)).otherwise(there)

    turns = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1)), lambda n: turn(n.cast("double"))))
    return F.element_at(turns, DIRECTIONS // 2 + 1)


def _rectified(rel: DataFrame) -> DataFrame:
    """Both cameras turned half of the relative rotation, then the baseline made the x axis."""
    w, x, y, z = _quat("r")
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    half = Q.normalize((w * sign + 1.0, x * sign, y * sign, z * sign))
    rel = rel.select("*", *[c.alias(f"h_{n}") for c, n in zip(half, POSE)])
    base = Q.rotate_inverse(_quat("h"), _shift("r"))
    rel = rel.select("*", *[c.alias(f"base_{n}") for c, n in zip(base, "xyz")])
    b = V.vec("base_x", "base_y", "base_z")
    rel = rel.withColumn("base", V.norm(b))
    e1 = V.scale(b, 1.0 / F.col("base"))
    flat = F.sqrt(e1[0] * e1[0] + e1[1] * e1[1])
    along = F.sqrt(e1[0] * e1[0] + e1[2] * e1[2])
    upright = flat >= 1e-10
    e2 = (F.when(upright, -e1[1] / flat).otherwise(e1[2] / along), F.when(upright, e1[0] / flat).otherwise(0.0), F.when(upright, 0.0).otherwise(-e1[0] / along))
    rel = rel.select("*", *[c.alias(f"{e}{n}") for e, v in (("u", e1), ("v", e2)) for c, n in zip(v, "xyz")])
    e3 = V.cross(V.vec("ux", "uy", "uz"), V.vec("vx", "vy", "vz"))
    mean = [((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2.0).alias(f"n_{c}") for c in CAMERA]
    return rel.select("*", *[c.alias(f"w{n}") for c, n in zip(e3, "xyz")], *mean)



def _ray(side: str, x: Column, y: Column) -> V.Vec:
    return ((x - F.col(f"{side}_cx")) / F.col(f"{side}_fx"), (y - F.col(f"{side}_cy")) / F.col(f"{side}_fy"), F.lit(1.0))


def in_order(feats: DataFrame, geometry: DataFrame, side: str, min_radius: float = 10.0, order: str = "auto") -> DataFrame:
    """The features of one side of every pair: (pair, fid, v, tie, px, py, polar, shape, descriptor).

    ``v`` is the place in the sweep; ``tie`` orders equal places. Positions for the candidate
    test are the rectified ones where rows are compared, else those of the image. ``order`` is
    ``auto``, ``polar``, ``rectified`` or ``given`` (the feature's own y).
    """
    image = "i" if side == "a" else "j"
    polar = {"auto": F.col("polar"), "polar": F.lit(True)}.get(order, F.lit(False))
    kept = [c for c in geometry.columns if c not in (image, "i", "j")]
    j = feats.withColumnRenamed("image_id", image).join(geometry.select(image, *kept), image)
    dx, dy = F.col("x") - F.col(f"{side}_ex"), F.col("y") - F.col(f"{side}_ey")
    theta = F.atan2(dy, dx)
    if side == "b":
        theta = _wrapped(theta - F.col("turn"))
    ray = _ray(side, F.col("x"), F.col("y"))
    turned = Q.rotate(_quat("h"), ray) if side == "a" else Q.rotate_inverse(_quat("h"), ray)
    j = j.select("*", *[c.alias(f"_{n}") for c, n in zip(turned, "xyz")], theta.alias("_theta"), F.sqrt(dx * dx + dy * dy).alias("_radius"), polar.alias("_polar"))
    p = V.vec("_x", "_y", "_z")
    depth = V.dot(V.vec("wx", "wy", "wz"), p)
    along = F.col("n_fx") * V.dot(V.vec("ux", "uy", "uz"), p) + F.col("n_cx") * depth
    if side == "b":
        along = along - F.col("n_fx") * F.col("base")
    rx, ry = along / depth, F.col("n_fy") * V.dot(V.vec("vx", "vy", "vz"), p) / depth + F.col("n_cy")
    own = F.col("_polar") | F.lit(order == "given")
    out = j.filter(~F.col("_polar") | (F.col("_radius") >= min_radius)).select(
        "pair", "fid",
        F.when(F.col("_polar"), F.col("_theta")).when(F.lit(order == "given"), F.col("y")).otherwise(ry).alias("v"),
        F.when(F.col("_polar"), F.col("_radius")).otherwise(0.0).alias("tie"),
        F.when(own, F.col("x")).otherwise(rx).alias("px"), F.when(own, F.col("y")).otherwise(ry).alias("py"),
        F.col("_polar").alias("polar"), *SHAPE, "descriptor",
    )
    return out.filter(F.col("v").isNotNull())


def _with_ghosts(targets: DataFrame, window: int) -> DataFrame:
    """Polar targets near the seam again, a full turn away on the other side."""
    n = targets.groupBy("pair").agg(F.count(F.lit(1)).alias("_n"))
    wide = targets.select("pair", "fid", "v", "tie", "polar").join(n, "pair")
    margin = F.least(F.lit(math.pi / 4), F.lit(2 * math.pi * window) / F.col("_n"))
    low = F.col("polar") & (F.col("v") < -math.pi + margin)
    high = F.col("polar") & (F.col("v") > math.pi - margin)
    at = F.array(F.col("v"), F.when(low, F.col("v") + 2 * math.pi), F.when(high, F.col("v") - 2 * math.pi))
    return wide.withColumn("v", F.explode(F.array_compact(at))).select("pair", "fid", "v", "tie")


@F.pandas_udf(T.DoubleType())
def depth_ratio(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """Depth in the first camera over depth in the second of the point that two pixels give by
    the linear method; NaN where there is none or it lies behind a camera.

    Cameras are lists (fx, fy, cx, cy, qw, qx, qy, qz, tx, ty, tz), pixels (x1, y1, x2, y2); null in, null out.
    """
    out = np.full(len(x), np.nan)
    there = np.flatnonzero(x.notna().to_numpy())
    if len(there):
        cams = [np.stack(s.to_numpy()[there]) for s in (a, b)]
        pix = np.stack(x.to_numpy()[there])
        out[there] = _linear_depth_ratio(cams[0], cams[1], pix)
    return pd.Series(out).where(x.notna())


def _projections(cam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3, 4) pose and projection matrices."""
    w, x, y, z = cam[:, 4:8].T
    rot = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]).transpose(2, 0, 1)
    pose = np.concatenate((rot, cam[:, 8:11, None]), axis=2)
    k = np.zeros((len(cam), 3, 3))
    k[:, 0, 0], k[:, 1, 1], k[:, 0, 2], k[:, 1, 2], k[:, 2, 2] = *cam[:, :4].T, 1.0
    return pose, k @ pose


def _linear_depth_ratio(a: np.ndarray, b: np.ndarray, pix: np.ndarray) -> np.ndarray:
    rows, poses = [], []
    for cam, xy in ((a, pix[:, :2]), (b, pix[:, 2:])):
        pose, p = _projections(cam)
        poses.append(pose[:, 2])
        rows += [xy[:, i, None] * p[:, 2] - p[:, i] for i in range(2)]
    point = np.linalg.svd(np.stack(rows, axis=1))[2][:, 3]
    far = np.abs(point[:, 3]) < 1e-12
    point = point / np.where(far, 1.0, point[:, 3])[:, None]
    first, second = ((p * point).sum(1) for p in poses)
    return np.where(far | (first <= 0) | (second <= 0), np.nan, first / np.where(second == 0, 1.0, second))


def _camera(side: str) -> Column:
    return F.array(*[F.col(f"{side}_{c}").cast("double") for c in (*CAMERA, *POSE)])


def fits(candidates: DataFrame, test: ShapeTest, forward: bool) -> DataFrame:
    """Candidates (q_*, c_* of both features, geometry of the pair) that pass the test.

    ``forward``: the query is of the first image. Shapes without direction fail.
    """
    m = Q.matrix(_quat("r"))
    m = (m[0][:2], m[1][:2]) if forward else ((m[0][0], m[1][0]), (m[0][1], m[1][1]))
    q = {c: F.col(f"q_{c}") for c in SHAPE}
    rows = [(m[r][0] * q["a11"] + m[r][1] * q["a21"], m[r][0] * q["a12"] + m[r][1] * q["a22"]) for r in range(2)]
    named = candidates.select("*", *[rows[r][c].alias(f"_t{r + 1}{c + 1}") for r in range(2) for c in range(2)])
    x, y = F.col("_t11"), F.col("_t21")
    length = F.sqrt(x * x + y * y) * F.sqrt(F.col("c_a11") * F.col("c_a11") + F.col("c_a21") * F.col("c_a21"))
    cosine = F.when(length > 0, (x * F.col("c_a11") + y * F.col("c_a21")) / length)
    named = named.filter(cosine >= math.cos(math.radians(test.max_turn)))
    one, two = ("a", "b") if forward else ("b", "a")
    rays = [_ray(s, F.col(f"{k}_px"), F.col(f"{k}_py")) for s, k in ((one, "q"), (two, "c"))]
    first = Q.rotate(_quat("r"), rays[0]) if forward else Q.rotate_inverse(_quat("r"), rays[0])
    ray_cos = V.clamp_cos(V.dot(first, rays[1]) / (V.norm(first) * V.norm(rays[1])))
    wide = ray_cos <= math.cos(math.radians(test.min_ray_angle))
    pixels = F.array("q_px", "q_py", "c_px", "c_py")
    named = named.withColumn("_pix", F.when(wide, pixels))
    named = named.withColumn("_depths", depth_ratio(_camera(one), _camera(two), F.col("_pix")))
    own = features.size(*[F.col(f"_t{r}{c}") for r in (1, 2) for c in (1, 2)]) * F.col("_depths")
    ratio = features.size(*[F.col(f"c_{c}") for c in SHAPE]) / own
    good = ~F.isnan("_depths") & (own > 0) & ratio.between(test.min_size_ratio, test.max_size_ratio)
    return named.filter(F.col("_pix").isNull() | good)


def _one_way(
    queries: DataFrame, targets: DataFrame, geometry: DataFrame, window: int, threshold: float | None, test: ShapeTest | None, forward: bool
) -> DataFrame:
    """(pair, qid, cid, d2): each query's best candidate by descriptor."""
    q = queries.select("pair", F.col("fid").alias("qid"), F.col("v").alias("y"))
    t = cut(_with_ghosts(targets, window)).select("pair", F.col("fid").alias("cid"), F.col("v").alias("y"), "tie")
    met = sweep_candidates(q, t, window, ties=("tie",))
    of = lambda df, key, tag: df.select(
        "pair", F.col("fid").alias(key), F.col("descriptor").alias(f"{tag}_d"), *[F.col(c).alias(f"{tag}_{c}") for c in ("px", "py", *SHAPE)]
    )
    met = met.join(of(queries, "qid", "q"), ["pair", "qid"]).join(of(targets, "cid", "c"), ["pair", "cid"])
    if test is not None:
        met = fits(met.join(geometry.drop("i", "j", "polar"), "pair"), test, forward)
    met = met.withColumn("d2", V.l2_squared("q_d", "c_d"))
    if threshold is not None:
        met = met.filter(F.col("d2") <= float(threshold * threshold))
    return met.groupBy("pair", "qid").agg(F.min(F.struct("d2", "ord", "cid")).alias("b")).select("pair", "qid", "b.cid", "b.d2")


def match_pairs(
    feats: DataFrame, geometry: DataFrame, window: int = 30, threshold: float | None = None,
    test: ShapeTest | None = None, order: str = "auto", min_radius: float = 10.0,
) -> DataFrame:
    """Mutual best matches of every pair of ``pair_geometry``: (pair, l, r, d2).

    feats (image_id, fid, x, y, a11, a12, a21, a22, descriptor); ``order`` as in ``in_order``.
    """
    left = cut(in_order(feats, geometry, "a", min_radius, order))
    right = cut(in_order(feats, geometry, "b", min_radius, order))
    there = _one_way(left, right, geometry, window, threshold, test, True).select("pair", F.col("qid").alias("l"), F.col("cid").alias("r"), "d2")
    back = _one_way(right, left, geometry, window, threshold, test, False).select("pair", F.col("cid").alias("l"), F.col("qid").alias("r"))
    return there.join(back, ["pair", "l", "r"])
