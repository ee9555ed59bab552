"""Discovery of points at infinity: features of different images that look alike in the same direction."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import triangulation
from .graph import connected_components

# Features that a tile of the sphere holds on average, rows of a block of a tile, and distances held at a time.
TILE_ROWS = 1024
BLOCK_ROWS = 16384
HELD = 1 << 20


@dataclass(frozen=True)
class InfinityParams:
    """Angle between directions in degrees, descriptor distance, ratio of best to second best, images of a track."""

    eps_deg: float = 1.0
    max_distance: float = 250.0
    ratio: float = 0.8
    min_views: int = 2


def mutual_links(features: DataFrame, params: InfinityParams) -> DataFrame:
    """(a, b, d2), a < b: features that are each other's best in the other's image.

    features (fid, image_id, dx, dy, dz, descriptor), unit directions. Among the features of one
    other image within the angle, the best has to be nearer than the limit, and than ``ratio``
    times the second best if there is one. Equal distances go to the smaller id.
    """
    near = _two_nearest(features, params)
    # Blocks send the two nearest of an image each.
    w = Window.partitionBy("a", "image").orderBy("d2", "b")
    two = near.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    best = two.groupBy("a", "image").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("b", "d2"))).alias("f"), F.max(F.when(F.col("_r") == 2, F.col("d2"))).alias("second")
    ).select("a", "f.b", "f.d2", "second")
    good = F.col("d2") < params.max_distance**2
    kept = cut(best.filter(good & (F.col("second").isNull() | (F.col("d2") < params.ratio**2 * F.col("second")))).select("a", "b", "d2"))
    back = kept.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return kept.filter("a < b").join(back, ["a", "b"])


def _two_nearest(features: DataFrame, params: InfinityParams, block: int = BLOCK_ROWS) -> DataFrame:
    """(a, image, b, d2): of the features of every other image within the angle, the two nearest of each block.

    Cubes at least as wide as the chord tile the sphere. A feature searches its own tile, to which all
    features within the chord of it are sent; both sides of a tile are cut into blocks by hash. A second
    best that can't fail the ratio for any best below the limit is left out.
    """
    chord = math.sqrt(2.0 * (1.0 - math.cos(math.radians(params.eps_deg))))
    d, tile, keys = ("dx", "dy", "dz"), ["_t0", "_t1", "_t2"], ["_t0", "_t1", "_t2", "_qb", "_cb"]
    # Of rows without a direction or a descriptor nothing is near.
    f = features.select("fid", "image_id", *d, "descriptor").dropna()
    side = max(chord, math.sqrt(4.0 * math.pi * TILE_ROWS / max(f.count(), 1)))
    q = f.withColumns({t: F.floor(F.col(c) / F.lit(side)) for t, c in zip(tile, d)})
    c = f.withColumn("_gap", F.lit(0.0))
    for t, x in zip(tile, d):
        own = F.floor(F.col(x) / F.lit(side))
        c = c.withColumn("_o", F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1)])))
        gap = F.when(F.col("_o") < 0, F.col(x) - own * side).when(F.col("_o") > 0, (own + 1) * side - F.col(x)).otherwise(0.0)
        c = c.withColumns({t: own + F.col("_o"), "_gap": F.col("_gap") + gap * gap}).filter(F.col("_gap") <= chord * chord * (1 + 1e-9) + 1e-15)
    size = lambda df, n: df.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(n))
    blocks = cut(size(q, "_qn").join(size(c, "_cn"), tile))
    hashed = lambda n: F.pmod(F.xxhash64("fid", "image_id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(blocks, tile).withColumn("_qb", hashed("_qn")).withColumn("_cb", every("_cn")).drop("_qn", "_cn")
    c = c.drop("_o", "_gap").join(blocks, tile).withColumn("_cb", hashed("_cn")).withColumn("_qb", every("_qn")).drop("_qn", "_cn")
    c = c.select(*[F.col(n).alias(n) for n in c.columns])
    kind = {n: features.schema[n].dataType.simpleString() for n in ("fid", "image_id")}
    kernel = _nearest_kernel(_largest_square(chord), params.max_distance**2, params.ratio**2)
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(kernel, f"a {kind['fid']}, image {kind['image_id']}, b {kind['fid']}, d2 double")


def _largest_square(chord: float) -> float:
    """The largest number whose root is at most ``chord``."""
    t = chord * chord
    while math.sqrt(t) > chord:
        t = math.nextafter(t, 0.0)
    while math.sqrt(math.nextafter(t, math.inf)) <= chord:
        t = math.nextafter(t, math.inf)
    return t


def _nearest_kernel(chord2: float, limit2: float, ratio2: float):
    bound = limit2 / ratio2 * (1 + 1e-9) if ratio2 > 0 else math.inf

    def kernel(lq: pd.DataFrame, rc: pd.DataFrame) -> pd.DataFrame:
        out = {n: [] for n in ("a", "image", "b", "d2")}
        if len(lq) and len(rc):
            lq, rc = lq.sort_values(["image_id", "fid"]), rc.sort_values(["image_id", "fid"])
            rc = rc[_earlier_copies(rc) < 2]
            (at, x), (to, y) = _numbers(lq), _numbers(rc)
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            scale = np.nanmax(xx, initial=0.0) + np.nanmax(yy, initial=0.0)
            slack = 1e-9 * (1.0 + (scale if np.isfinite(scale) else 0.0))
            image, starts, part = np.unique(rc["image_id"].to_numpy(), return_index=True, return_inverse=True)
            own, a, b = lq["image_id"].to_numpy(), lq["fid"].to_numpy(), rc["fid"].to_numpy()
            step = max(1, HELD // len(rc))
            for s in range(0, len(lq), step):
                e = slice(s, s + step)
                gap = at[e, 0, None] - to[None, :, 0]
                gap *= gap
                for j in (1, 2):
                    more = at[e, j, None] - to[None, :, j]
                    more *= more
                    gap += more
                near = xx[e, None] + yy[None, :] - 2.0 * (x[e] @ y.T)
                # Also false where a number is not one.
                fine = (gap <= chord2) & (near < bound + slack) & (own[e, None] != image[part][None, :])
                near[~fine] = np.inf
                first = np.minimum.reduceat(near, starts, axis=1)
                second = np.minimum.reduceat(np.where(near <= first[:, part] + slack, np.inf, near), starts, axis=1)
                row, col = np.nonzero(fine & (near <= (second + slack)[:, part]))
                d2 = _squared(x, y, s + row, col)
                order = np.lexsort((col, d2, part[col], row))
                row, col, d2 = row[order], col[order], d2[order]
                group = row * len(image) + part[col]
                keep = (np.arange(len(group)) - np.searchsorted(group, group) < 2) & (d2 < bound)
                for n, v in (("a", a[s + row]), ("image", image[part[col]]), ("b", b[col]), ("d2", d2)):
                    out[n].append(v[keep])
        return pd.DataFrame({n: np.concatenate(v) if v else np.array([]) for n, v in out.items()})

    return kernel


def _numbers(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return df[["dx", "dy", "dz"]].to_numpy(np.float64), np.stack(df["descriptor"].to_numpy()).astype(np.float64)


def _earlier_copies(df: pd.DataFrame) -> np.ndarray:
    """How many equal features of the same image precede each row; only two copies can be the two nearest."""
    d, e = _numbers(df)
    image = np.unique(df["image_id"].to_numpy(), return_inverse=True)[1]
    rows = np.ascontiguousarray(np.column_stack((image, d, e)))
    same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    before = np.empty(len(df), np.int64)
    before[order] = np.arange(len(df)) - np.searchsorted(same[order], same[order])
    return before


def _squared(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs, summed in the order of the numbers."""
    d2 = np.zeros(len(row))
    for j in range(x.shape[1]):
        step = x[row, j] - y[col, j]
        d2 += step * step
    return d2


def infinity_tracks(features: DataFrame, params: InfinityParams = InfinityParams()) -> DataFrame:
    """(track, image_id, fid): linked features, one per image.

    A track is a connected part of the mutual links, named by its smallest feature; of an image's
    features the one with the smallest sum of distances to its neighbours stays (then the smaller
    id), and parts of fewer than ``min_views`` images go.
    """
    links = cut(mutual_links(features, params))
    both = links.select("a", "d2").unionByName(links.select(F.col("b").alias("a"), "d2"))
    support = both.groupBy(F.col("a").alias("fid")).agg(F.sum("d2").alias("support"))
    roots = connected_components(links, "a", "b").select(F.col("node").alias("fid"), F.col("root").alias("track"))
    one = support.join(roots, "fid").join(features.select("fid", "image_id"), "fid").groupBy("track", "image_id").agg(
        F.min(F.struct("support", "fid")).alias("m")
    )
    wide = one.groupBy("track").count().filter(F.col("count") >= params.min_views).select("track")
    return one.join(wide, "track").select("track", "image_id", F.col("m.fid").alias("fid"))


def find_infinity_points(features: DataFrame, centers: DataFrame, horizon: float, params: InfinityParams = InfinityParams()) -> DataFrame:
    """Tracks as finite points, points at infinity or indeterminate: (track, n, class, x, y, z, w).

    features also carry ``sigma``, the angle a keypoint may be off; centers (image_id, cx, cy, cz).
    """
    tracks = infinity_tracks(features, params)
    rays = tracks.join(features.select("fid", "dx", "dy", "dz", "sigma"), "fid").join(centers.select("image_id", "cx", "cy", "cz"), "image_id")
    return triangulation.classify_infinity(cut(rays.select("track", "cx", "cy", "cz", "dx", "dy", "dz", "sigma")), horizon)
