"""Surface normals of points from the directions to their neighbours, robustly reweighted."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V
from ..session import cut
from .skew import exact_median

#: Spread of a median deviation, share of the largest weight that counts as live.
MAD_TO_SIGMA, LIVE = 1.4826, 0.25
#: Neighbours of a point that one task holds together.
WHOLE = 100_000
AXES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz", "low", "mid", "top")])
_D = ("dx", "dy", "dz")
_UPPER = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


@dataclass(frozen=True)
class SurfelParams:
    """Rounds of reweighting, Tukey constant, least scale in degrees, sectors of the tangent plane, and what a
    determined normal needs: effective neighbours, occupied sectors, ratio of the two larger eigenvalues."""

    rounds: int = 3
    tukey: float = 4.685
    floor_deg: float = 2.0
    sectors: int = 8
    min_effective: float = 4.0
    min_sectors: int = 3
    min_anisotropy: float = 0.10


@F.pandas_udf(AXES)
def axes(a00: pd.Series, a01: pd.Series, a02: pd.Series, a11: pd.Series, a12: pd.Series, a22: pd.Series) -> pd.DataFrame:
    """Axis of the smallest eigenvalue and the three eigenvalues of a symmetric matrix."""
    m = np.empty((len(a00), 3, 3))
    for (i, j), s in zip(_UPPER, (a00, a01, a02, a11, a12, a22), strict=True):
        m[:, i, j] = m[:, j, i] = s
    value, vector = np.linalg.eigh(m)
    return pd.DataFrame(np.column_stack((vector[:, :, 0], value)), columns=[f.name for f in AXES])


def directions(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p, dx, dy, dz): unit directions from each point to its neighbours; pairs (p, q), either order. Coinciding points have none."""
    at = lambda key, t: points.select(F.col("point_id").alias(key), *[F.col(c).alias(f"{t}{c}") for c in "xyz"])
    j = pairs.select("p", "q").join(at("p", "p_"), "p").join(at("q", "q_"), "q")
    off = V.sub(V.vec("q_x", "q_y", "q_z"), V.vec("p_x", "p_y", "p_z"))
    j = j.select("p", "q", *[c.alias(n) for c, n in zip(off, ("ox", "oy", "oz"))], V.norm(off).alias("n")).filter("n > 1e-12")
    there = [F.col(f"o{c}") / F.col("n") for c in "xyz"]
    sides = [F.struct(F.col(k).alias("p"), *[(sign * d).alias(f"d{c}") for c, d in zip("xyz", there)]) for k, sign in (("p", 1.0), ("q", -1.0))]
    return j.select(F.explode(F.array(*sides)).alias("s")).select("s.*")


def _fit(rows: DataFrame) -> DataFrame:
    d = V.vec(*_D)
    sums = rows.groupBy("p").agg(*[F.sum(F.col("w") * d[i] * d[j]).alias(f"a{i}{j}") for i, j in _UPPER])
    return cut(sums.select("p", axes(*[f"a{i}{j}" for i, j in _UPPER]).alias("e")).select("p", "e.*"))


def _off_plane() -> Column:
    return F.abs(V.dot(V.vec(*_D), V.vec("nx", "ny", "nz")))


def surfel_normals(dirs: DataFrame, views: DataFrame, params: SurfelParams = SurfelParams(), whole: int = WHOLE) -> DataFrame:
    """One row per point of two neighbours or more: (p, nx, ny, nz, n_support, n_eff, anisotropy, sectors,
    sigma_deg, resid_deg, determined).

    dirs as from ``directions``; views (p, vx, vy, vz), the side from which the point is seen, one a point.
    The plane through the point is fitted by sums, neighbours are reweighted by their angle to it against the
    median angle, and a point whose weights would all vanish keeps its last ones.

    Points of up to ``whole`` neighbours are fitted in one pass, many at once; those of more by
    sums and medians that go through shuffles, round by round, with the same results.
    """
    dirs = cut(dirs)
    crowded = cut(dirs.groupBy("p").count().filter(F.col("count") > whole).select("p"))
    if crowded.isEmpty():
        return _fitted_at_once(dirs, views, params)
    # Fewer than one point in ``whole`` directions.
    few = _fitted_at_once(dirs.join(F.broadcast(crowded), "p", "left_anti"), views, params)
    return few.unionByName(_fitted_in_rounds(dirs.join(F.broadcast(crowded), "p", "left_semi"), views, params))


def _fitted_at_once(dirs: DataFrame, views: DataFrame, params: SurfelParams) -> DataFrame:
    """Rows of a point come one after another: its view first, then its directions."""
    kind = dirs.schema["p"].dataType.simpleString()
    seen = views.select("p", F.lit(0).alias("k"), *[F.col(c).cast("double").alias(d) for c, d in zip(("vx", "vy", "vz"), _D)])
    rows = seen.unionByName(dirs.select("p", F.lit(1).alias("k"), *_D)).repartition("p").sortWithinPartitions("p", "k")

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat((held, b), ignore_index=True)
            if len(held):
                last = held["p"].to_numpy() == held["p"].iloc[-1]
                if not last.all():
                    yield _normals(held[~last], params)
                    held = held[last]
        if held is not None and len(held):
            yield _normals(held, params)

    return rows.mapInPandas(run, f"p {kind}, nx double, ny double, nz double, n_support long, n_eff double, anisotropy double, sectors long, sigma_deg double, resid_deg double, determined boolean")


def _normals(t: pd.DataFrame, params: SurfelParams) -> pd.DataFrame:
    """Fits of many points, rows ordered by point and view first."""
    is_dir = t["k"].to_numpy() == 1
    view = t[~is_dir].drop_duplicates("p").set_index("p")[list(_D)]
    t = t[is_dir & t["p"].isin(view.index).to_numpy()]
    _, of, n = np.unique(t["p"].to_numpy(), return_inverse=True, return_counts=True)
    t = t[n[of] >= 2]
    ids, first, of, n = np.unique(t["p"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
    d, v = t[list(_D)].to_numpy(float), view.loc[ids].to_numpy(float)
    add = lambda x: np.add.reduceat(x, first) if len(x) else x

    def plane(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.empty((len(ids), 3, 3))
        for i, j in _UPPER:
            m[:, i, j] = m[:, j, i] = add(w * d[:, i] * d[:, j])
        value, vector = np.linalg.eigh(m)
        return value, vector[:, :, 0]

    off = lambda normal: np.abs((d * normal[of]).sum(axis=1))
    w, live, sigma = np.ones(len(t)), np.ones(len(ids), dtype=bool), np.full(len(ids), np.nan)
    for _ in range(params.rounds):
        r = off(plane(w)[1])
        ranked = r[np.lexsort((r, of))]
        low, high = ranked[first + (n - 1) // 2], ranked[first + n // 2]
        scale = np.maximum(MAD_TO_SIGMA * (low + (high - low) * 0.5), math.sin(math.radians(params.floor_deg)))
        u = r / (params.tukey * scale)[of]
        robust = np.where(u < 1.0, (1.0 - u * u) ** 2, 0.0)
        sigma = np.where(live, scale, sigma)
        live = live & (add(robust) > 1e-12)
        w = np.where(live[of], robust, w)
    value, normal = plane(w)
    normal = normal * np.where((normal * v).sum(axis=1) < 0, -1.0, 1.0)[:, None]
    size = np.sqrt((v * v).sum(axis=1))[:, None]
    v = np.where(size < 1e-9, [0.0, 0.0, 1.0], v / np.where(size < 1e-9, 1.0, size))
    seed = np.where(np.abs(v[:, 2:]) > 0.95, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0])
    e1 = seed - v * (seed * v).sum(axis=1)[:, None]
    e1 = e1 / np.maximum(np.sqrt((e1 * e1).sum(axis=1)), 1e-12)[:, None]
    angle = np.arctan2((d * np.cross(v, e1)[of]).sum(axis=1), (d * e1[of]).sum(axis=1))
    sector = np.floor((angle / (2 * math.pi) + 1.0) * params.sectors).astype(int) % params.sectors
    top_w = np.maximum.reduceat(w, first) if len(w) else w
    alive = w >= LIVE * np.maximum(top_w, 1e-30)[of]
    seen = np.zeros((len(ids), params.sectors), dtype=bool)
    seen[of[alive], sector[alive]] = True
    degrees = lambda s: np.degrees(np.arcsin(np.minimum(s, 1.0)))
    r, sw = off(normal), add(w)
    out = pd.DataFrame({
        "p": ids, "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "n_support": n, "n_eff": sw * sw / np.maximum(add(w * w), 1e-30),
        "anisotropy": np.where(value[:, 2] > 1e-30, value[:, 1] / np.where(value[:, 2] > 1e-30, value[:, 2], 1.0), 0.0), "sectors": seen.sum(axis=1),
        "sigma_deg": degrees(sigma), "resid_deg": degrees(np.sqrt(np.maximum(add(w * r * r), 0.0) / np.maximum(sw, 1e-30))),
    })
    return out.assign(determined=(out["n_eff"] >= params.min_effective) & (out["sectors"] >= params.min_sectors) & (out["anisotropy"] >= params.min_anisotropy))


def _fitted_in_rounds(dirs: DataFrame, views: DataFrame, params: SurfelParams) -> DataFrame:
    several = dirs.groupBy("p").agg(F.count(F.lit(1)).alias("n_support")).filter("n_support >= 2")
    rows = cut(dirs.join(several.select("p"), "p", "left_semi").withColumn("w", F.lit(1.0)).withColumn("live", F.lit(True)))
    sigma = several.select("p", F.lit(float("nan")).alias("sigma"))
    floor = math.sin(math.radians(params.floor_deg))
    for _ in range(params.rounds):
        off = rows.filter("live").join(_fit(rows.filter("live")).select("p", "nx", "ny", "nz"), "p").select("p", *_D, "w", _off_plane().alias("r"))
        off = cut(off)
        scale = exact_median(off, ["p"], "r").select("p", F.greatest(MAD_TO_SIGMA * F.col("median"), F.lit(floor)).alias("scale"))
        u = F.col("r") / (params.tukey * F.col("scale"))
        robust = F.when(u < 1.0, (1.0 - u * u) * (1.0 - u * u)).otherwise(0.0)
        off = cut(off.join(scale, "p").withColumn("robust", robust))
        total = off.groupBy("p").agg(F.first("scale").alias("scale"), (F.sum("robust") > 1e-12).alias("moves"))
        sigma = cut(sigma.join(total.select("p", "scale"), "p", "left").select("p", F.coalesce("scale", "sigma").alias("sigma")))
        new = off.join(total.select("p", "moves"), "p").select("p", *_D, F.when(F.col("moves"), F.col("robust")).otherwise(F.col("w")).alias("w"), F.col("moves").alias("live"))
        rows = cut(new.unionByName(rows.filter("NOT live")))
    fit = _fit(rows).join(views.select("p", "vx", "vy", "vz"), "p")
    toward = F.when(V.dot(V.vec("nx", "ny", "nz"), V.vec("vx", "vy", "vz")) < 0, -1.0).otherwise(1.0)
    fit = cut(fit.select("p", *[(F.col(c) * toward).alias(c) for c in ("nx", "ny", "nz")], "mid", "top", "vx", "vy", "vz"))
    top_w = rows.groupBy("p").agg(F.max("w").alias("max_w"))
    j = _with_sector(rows.join(fit, "p").join(top_w, "p"), params.sectors)
    r = _off_plane()
    alive = F.col("w") >= LIVE * F.greatest(F.col("max_w"), F.lit(1e-30))
    sums = j.groupBy("p").agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * r * r).alias("swr2"),
        F.bit_or(F.when(alive, F.pow(F.lit(2.0), F.col("sector")).cast("long")).otherwise(F.lit(0).cast("long"))).alias("mask"),
    )
    out = fit.join(sums, "p").join(several, "p").join(sigma, "p")
    tiny = F.lit(1e-30)
    degrees = lambda s: F.degrees(F.asin(F.least(s, F.lit(1.0))))
    out = out.select(
        "p", "nx", "ny", "nz", "n_support", (F.col("sw") * F.col("sw") / F.greatest("sw2", tiny)).alias("n_eff"),
        F.when(F.col("top") > 1e-30, F.col("mid") / F.col("top")).otherwise(0.0).alias("anisotropy"),
        F.bit_count("mask").cast("long").alias("sectors"), F.when(F.isnan("sigma"), F.col("sigma")).otherwise(degrees(F.col("sigma"))).alias("sigma_deg"),
        degrees(F.sqrt(F.greatest("swr2", F.lit(0.0)) / F.greatest("sw", tiny))).alias("resid_deg"),
    )
    sure = (F.col("n_eff") >= params.min_effective) & (F.col("sectors") >= params.min_sectors) & (F.col("anisotropy") >= params.min_anisotropy)
    return out.withColumn("determined", sure)


def _with_sector(j: DataFrame, sectors: int) -> DataFrame:
    """Adds ``sector``, the direction's place around the viewing direction."""
    size = V.norm(V.vec("vx", "vy", "vz"))
    flat = size < 1e-9
    j = j.select("*", *[F.when(flat, F.lit(d)).otherwise(F.col(c) / size).alias(f"_{c}") for c, d in (("vx", 0.0), ("vy", 0.0), ("vz", 1.0))])
    v = V.vec("_vx", "_vy", "_vz")
    steep = F.abs(v[2]) > 0.95
    seed = (F.when(steep, 1.0).otherwise(0.0), F.lit(0.0), F.when(steep, 0.0).otherwise(1.0))
    e1 = V.sub(seed, V.scale(v, V.dot(seed, v)))
    j = j.select("*", *[c.alias(f"_e{n}") for c, n in zip(e1, "xyz")])
    e1 = V.scale(V.vec("_ex", "_ey", "_ez"), 1.0 / F.greatest(V.norm(V.vec("_ex", "_ey", "_ez")), F.lit(1e-12)))
    d = V.vec(*_D)
    angle = F.atan2(V.dot(d, V.cross(v, e1)), V.dot(d, e1))
    return j.withColumn("sector", F.pmod(F.floor((angle / (2 * math.pi) + 1.0) * sectors), F.lit(sectors)).cast("int"))
