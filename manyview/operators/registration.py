"""Bringing many reconstructions into one frame, and splitting one into rigid fragments.

Every fit is a plan over sums: posed cameras give the sixteen numbers of a similarity (the
quaternion outer products of their relative rotations, means, cross-covariance) by map-side
aggregation for all groups at once, and a few numbers per group are solved in batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import vec as V
from ..session import cut
from . import align
from .skew import self_pairs

POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
FIT = ("fw", "fx", "fy", "fz", "scale", "ox", "oy", "oz")
_S, _T = ("sx", "sy", "sz"), ("cx", "cy", "cz")
_Q = tuple((a, b) for a in range(4) for b in range(a, 4))


def camera_sums(matches: DataFrame, *keys: str) -> DataFrame:
    """Sums of posed pairs per key: matches (s_qw.., sx, sy, sz; t_qw.., cx, cy, cz), source and target."""
    rel = Q.mul(Q.conj(Q.quat(*[f"t_{c}" for c in POSE[:4]])), Q.quat(*[f"s_{c}" for c in POSE[:4]]))
    m = matches.select("*", *[c.alias(f"_r{k}") for k, c in enumerate(rel)])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(f"_r{a}") * F.col(f"_r{b}")).alias(f"q{a}{b}") for a, b in _Q]
    aggs += [F.avg(c).alias(f"m_{c}") for c in (*_S, *_T)]
    aggs += [F.covar_pop(t, s).alias(f"c_{t}_{s}") for t in _T for s in _S]
    aggs += [F.var_pop(c).alias(f"v_{c}") for c in _S]
    return m.groupBy(*keys).agg(*aggs)


def solve_cameras(sums: pd.DataFrame) -> np.ndarray:
    """(n, 8) rotation, scale and offset: mean rotation of the cameras, then scale and offset given it."""
    outer = np.zeros((len(sums), 4, 4))
    for a, b in _Q:
        outer[:, a, b] = outer[:, b, a] = sums[f"q{a}{b}"]
    q = np.linalg.eigh(outer)[1][:, :, 3]
    q *= np.where(q[:, :1] < 0, -1.0, 1.0)
    rot = rotations(q)
    cov = sums[[f"c_{t}_{s}" for t in _T for s in _S]].to_numpy(float).reshape(-1, 3, 3)
    spread = sums[[f"v_{c}" for c in _S]].to_numpy(float).sum(1)
    scale = np.where(spread > 0, (rot * cov).sum((1, 2)) / np.where(spread > 0, spread, 1.0), 1.0)
    from_, to = (sums[[f"m_{c}" for c in cols]].to_numpy(float) for cols in (_S, _T))
    offset = to - scale[:, None] * np.einsum("nij,nj->ni", rot, from_)
    return np.column_stack((q, scale, offset))


def rotations(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]).transpose(2, 0, 1)


def fit_cameras(matches: DataFrame, key: str) -> DataFrame:
    """One similarity per key from its posed pairs: (key, fw..fz, scale, ox, oy, oz)."""
    sums = camera_sums(matches, key)
    kind = sums.schema[key].dataType.simpleString()

    def solve(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame(solve_cameras(b), columns=list(FIT)).assign(**{key: b[key].to_numpy()})[[key, *FIT]]

    return sums.mapInPandas(solve, f"{key} {kind}, " + ", ".join(f"{c} double" for c in FIT))


def _move(center: V.Vec) -> V.Vec:
    """A centre under the similarity in the FIT columns."""
    turned = Q.rotate(Q.quat(*FIT[:4]), center)
    return V.add(V.scale(turned, F.col("scale")), V.vec(*FIT[5:]))


def settle_order(edges: DataFrame, reference) -> DataFrame:
    """(recon, sweep): when repeated sweeps over the reconstructions by id first reach each one.

    edges (a, b) hold both directions. In a sweep a reconstruction is taken once any of its
    neighbours is, also one taken earlier in the same sweep; the reference is taken before.
    """
    spark = edges.sparkSession
    known = spark.createDataFrame([(reference, 0)], f"recon {edges.schema['a'].dataType.simpleString()}, sweep int")
    size = 1
    while True:
        after = F.when((F.col("sweep") >= 1) & (F.col("recon") < F.col("b")), F.col("sweep")).otherwise(F.col("sweep") + 1)
        met = edges.join(known, edges["a"] == known["recon"]).select(F.col("b").alias("recon"), after.alias("sweep"))
        known = cut(known.unionByName(met).groupBy("recon").agg(F.min("sweep").alias("sweep")))
        total = known.agg(F.count(F.lit(1)), F.sum("sweep")).first()
        if tuple(total) == size:
            return known
        size = tuple(total)


def align_all(images: DataFrame, reference) -> DataFrame:
    """Similarities that bring all reconstructions onto one: (recon, sweep, fw..fz, scale, ox, oy, oz).

    images (recon, image_id, name, pose). Reconstructions are taken in sweeps in the order
    of their ids; each is fitted to all shared images of those taken before it, as moved.
    What does not depend on each other is fitted in one round. A repeated name counts for the
    smallest image id; reconstructions without a path of shared images to the reference have no row.
    """
    first = images.groupBy("recon", "name").agg(F.min_by(F.struct(*POSE), "image_id").alias("p")).select("recon", "name", "p.*")
    q, t = Q.quat(*POSE[:4]), V.vec(*POSE[4:])
    named = cut(first.select("recon", "name", *POSE[:4], *[c.alias(f"c{k}") for c, k in zip(Q.camera_center(q, t), "xyz")]))
    met = self_pairs(named, ["name"], "recon")
    cols = [*POSE[:4], "cx", "cy", "cz"]
    way = lambda s, d: met.select(
        F.col(f"{d}_recon").alias("recon"), F.col(f"{s}_recon").alias("to"),
        *[F.col(f"{d}_{c}").alias(f"s_{c}" if c in POSE else n) for c, n in zip(cols, ("", "", "", "", *_S))],
        *[F.col(f"{s}_{c}").alias(f"t_{c}" if c in POSE else c) for c in cols],
    )
    both = cut(way("a", "b").unionByName(way("b", "a")))
    edges = cut(both.select(F.col("to").alias("a"), F.col("recon").alias("b")).distinct())
    order = settle_order(edges, reference)
    # Pairs with those taken before: smaller sweep, or the same sweep and a smaller id.
    own = order.withColumnRenamed("sweep", "own")
    matches = both.join(own, "recon").join(order.select(F.col("recon").alias("to"), F.col("sweep").alias("theirs")), "to")
    matches = cut(matches.filter((F.col("theirs") < F.col("own")) | ((F.col("theirs") == F.col("own")) & (F.col("to") < F.col("recon")))))
    needs = cut(matches.select("recon", "to").distinct())
    kind = named.schema["recon"].dataType.simpleString()
    done = images.sparkSession.createDataFrame(
        [(reference, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], f"recon {kind}, " + ", ".join(f"{c} double" for c in FIT)
    )
    while True:
        waiting = needs.join(done.select("recon"), "recon", "left_anti")
        held = waiting.join(done.select(F.col("recon").alias("to")), "to", "left_anti").select("recon").distinct()
        ready = cut(waiting.select("recon").distinct().join(held, "recon", "left_anti"))
        if ready.isEmpty():
            return order.join(done, "recon").select("recon", "sweep", *FIT)
        at = matches.join(ready, "recon").join(done.withColumnRenamed("recon", "to"), "to")
        moved = _move(V.vec(*_T))
        turned = Q.mul(Q.quat(*[f"t_{c}" for c in POSE[:4]]), Q.conj(Q.quat(*FIT[:4])))
        at = at.select("recon", *[f"s_{c}" for c in POSE[:4]], *_S, *[c.alias(f"t_{n}") for c, n in zip(turned, POSE)], *[c.alias(n) for c, n in zip(moved, _T)])
        done = cut(done.unionByName(fit_cameras(at, "recon")))


def move_images(images: DataFrame, fits: DataFrame) -> DataFrame:
    """Images (recon, pose) of every fitted reconstruction in the reference's frame."""
    q, t = Q.quat(*POSE[:4]), V.vec(*POSE[4:])
    rest = [c for c in images.columns if c not in POSE]
    j = images.join(fits.select("recon", *FIT), "recon")
    turned = Q.mul(q, Q.conj(Q.quat(*FIT[:4])))
    j = j.select(*rest, *[c.alias(n) for c, n in zip((*turned, *_move(Q.camera_center(q, t))), (*POSE[:4], *_T))])
    shift = V.neg(Q.rotate(Q.quat(*POSE[:4]), V.vec(*_T)))
    return j.select(*rest, *POSE[:4], *[c.alias(n) for c, n in zip(shift, POSE[4:])])


def move_points(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Points (recon, x, y, z, w) of every fitted reconstruction; directions (w = 0) only turn."""
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    turned = Q.rotate(Q.quat(*FIT[:4]), V.vec("x", "y", "z"))
    moved = _move(V.vec("x", "y", "z"))
    xyz = [F.when(F.col("w") == 0.0, a).otherwise(b).alias(n) for a, b, n in zip(turned, moved, "xyz")]
    return points.join(fits.select("recon", *FIT), "recon").select(*rest, *xyz)


def fit_by_points(pairs: DataFrame, min_points: int = 10, percentile: float = 95.0, iterations: int = 64) -> tuple[align.Similarity, int, int]:
    """Similarity from corresponding points (pair_id, sx.., tx..), and the numbers of pairs and of inliers.

    A first fit's residual percentile is the threshold of a consensus whose inliers are fitted
    again. Points at infinity have no place here; leave them out before.
    """
    n = pairs.count()
    if n < min_points:
        raise ValueError(f"{n} corresponding points, {min_points} are needed")
    if n == min_points:
        return align.fit_similarity(pairs), n, n
    res = align.residuals(pairs, align.fit_similarity(pairs))
    limit = align.exact_quantiles(res, [], "residual", {"q": percentile / 100.0}).first()["q"]
    fit, inliers = align.ransac_similarity(pairs, float(limit), iterations)
    if inliers < min_points:
        raise ValueError(f"{inliers} of {n} points agree, {min_points} are needed")
    return fit, n, inliers


@dataclass(frozen=True)
class FragmentLimits:
    """Consensus limits; position in percent of the scene scale, rotation in degrees."""

    position: float = 3.5
    rotation: float = 5.0
    min_size: int = 5
    candidates: int = 1000
    rounds: int = 10
    seed: int = 0


def _errors(fit: np.ndarray, scene_scale: float) -> tuple[Column, Column]:
    """Position error in percent of the scale and rotation error in degrees under one similarity."""
    lit = [F.lit(float(v)) for v in fit]
    moved = V.add(V.scale(Q.rotate(tuple(lit[:4]), V.vec(*_S)), lit[4]), tuple(lit[5:]))
    off = V.norm(V.sub(moved, V.vec(*_T))) / F.lit(float(scene_scale)) * 100.0
    turned = Q.mul(Q.quat(*[f"s_{c}" for c in POSE[:4]]), Q.conj(tuple(lit[:4])))
    same = F.abs(Q.dot4(turned, Q.quat(*[f"t_{c}" for c in POSE[:4]])))
    return off, F.degrees(2.0 * F.acos(F.least(same, F.lit(1.0))))


_NUMBERS = (*[f"s_{c}" for c in POSE[:4]], *_S, *[f"t_{c}" for c in POSE[:4]], *_T)


def _candidates(left: DataFrame, limits: FragmentLimits, floor: float, drawn: int) -> np.ndarray:
    """Similarities from two cameras each: all pairs of few cameras, else ``limits.candidates`` drawn pairs.

    The cameras with the smallest hashes are the only rows that reach the driver.
    """
    rows = left.orderBy(F.xxhash64(F.lit(limits.seed + drawn), "id"), "id").limit(2 * limits.candidates).select("id", *_NUMBERS).toPandas()
    rows = rows.sort_values("id", ignore_index=True)
    n = len(rows)
    if n * (n - 1) // 2 <= limits.candidates:
        a, b = np.triu_indices(n, 1)
    else:
        rng = np.random.default_rng(limits.seed + drawn)
        a, b = rng.integers(0, n, limits.candidates), rng.integers(0, n - 1, limits.candidates)
        b = b + (b >= a)
    v = rows[list(_NUMBERS)].to_numpy(float)
    s, t = v[:, 4:7], v[:, 11:14]
    apart = (np.linalg.norm(s[a] - s[b], axis=1) >= floor) & (np.linalg.norm(t[a] - t[b], axis=1) >= floor)
    a, b = a[apart], b[apart]
    if not len(a):
        return np.zeros((0, 8))
    rel = _multiply(v[:, 7:11] * [1, -1, -1, -1], v[:, :4])
    sums = {"n": np.full(len(a), 2)}
    sums |= {f"q{i}{j}": rel[a, i] * rel[a, j] + rel[b, i] * rel[b, j] for i, j in _Q}
    for names, x in ((_S, s), (_T, t)):
        sums |= {f"m_{c}": (x[a, k] + x[b, k]) / 2 for k, c in enumerate(names)}
    ds, dt = (s[a] - s[b]) / 2, (t[a] - t[b]) / 2
    sums |= {f"c_{p}_{q}": dt[:, i] * ds[:, j] for i, p in enumerate(_T) for j, q in enumerate(_S)}
    sums |= {f"v_{c}": ds[:, k] ** 2 for k, c in enumerate(_S)}
    fits = solve_cameras(pd.DataFrame(sums))
    return fits[fits[:, 4] > 0]


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (aw, ax, ay, az), (bw, bx, by, bz) = a.T, b.T
    return np.stack((
        aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw,
    ), axis=1)


def _agreeing(left: DataFrame, fits: np.ndarray, scene_scale: float, limits: FragmentLimits) -> np.ndarray:
    """Number of cameras within the limits of each candidate; all are scored in one pass."""
    rot = rotations(fits[:, :4])

    def score(batches):
        total = np.zeros(len(fits), np.int64)
        for b in batches:
            for lo in range(0, len(b), 1024):
                v = b.iloc[lo : lo + 1024][list(_NUMBERS)].to_numpy(float)
                moved = fits[:, None, 4, None] * np.einsum("kij,nj->kni", rot, v[:, 4:7]) + fits[:, None, 5:]
                off = np.linalg.norm(moved - v[None, :, 11:14], axis=2) / scene_scale * 100.0
                back = _multiply(v[:, 7:11] * [1, -1, -1, -1], v[:, :4])
                same = np.abs(back @ fits[:, :4].T).T
                turn = np.degrees(2.0 * np.arccos(np.minimum(same, 1.0)))
                total += ((off < limits.position) & (turn < limits.rotation)).sum(1)
        yield pd.DataFrame({"k": np.arange(len(fits)), "n": total})

    out = np.zeros(len(fits), np.int64)
    for r in left.select(*_NUMBERS).mapInPandas(score, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def rigid_fragments(matches: DataFrame, scene_scale: float, limits: FragmentLimits = FragmentLimits()) -> DataFrame:
    """Splits shared cameras into fragments that one similarity each maps onto the target.

    matches (id, s_qw.., sx.., t_qw.., cx..). Largest consensus first, refitted until its members
    stay, then the same over what is left, until no consensus has ``min_size`` members. Returns
    (id, component, position_error, rotation_error): component from 1, null for cameras in none,
    whose errors are those under the first component's similarity.
    """
    left = cut(matches.select("id", *_NUMBERS))
    out, first, n = None, None, 0
    while True:
        count = left.count()
        if count < max(2, limits.min_size):
            break
        fits = _candidates(left, limits, 1e-9 * max(scene_scale, 1e-12), n)
        if not len(fits):
            break
        agree = _agreeing(left, fits, scene_scale, limits)
        fit = fits[agree.argmax()]
        if agree.max() < limits.min_size:
            break
        members = cut(_marked(left, fit, scene_scale, limits).filter("inside").drop("inside"))
        for _ in range(limits.rounds):
            again = solve_cameras(camera_sums(members).toPandas())[0]
            if again[4] <= 0:
                break
            marked = cut(_marked(left, again, scene_scale, limits).join(members.select("id", F.lit(True).alias("was")), "id", "left"))
            size = marked.agg(F.sum(F.col("inside").cast("long")).alias("n"), F.sum((F.col("inside") != F.coalesce("was", F.lit(False))).cast("long")).alias("moved")).first()
            if size["n"] < limits.min_size:
                break
            fit, members = again, marked.filter("inside").drop("inside", "was")
            if not size["moved"]:
                break
        n += 1
        first = fit if first is None else first
        off, turn = _errors(fit, scene_scale)
        part = members.select("id", F.lit(n).alias("component"), off.alias("position_error"), turn.alias("rotation_error"))
        out = part if out is None else out.unionByName(part)
        left = cut(left.join(members.select("id"), "id", "left_anti"))
    off, turn = _errors(first, scene_scale) if first is not None else (F.lit(None).cast("double"),) * 2
    rest = left.select("id", F.lit(None).cast("int").alias("component"), off.alias("position_error"), turn.alias("rotation_error"))
    return rest if out is None else out.unionByName(rest)


def _marked(left: DataFrame, fit: np.ndarray, scene_scale: float, limits: FragmentLimits) -> DataFrame:
    off, turn = _errors(fit, scene_scale)
    return left.withColumn("inside", (off < limits.position) & (turn < limits.rotation))
