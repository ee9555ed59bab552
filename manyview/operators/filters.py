"""Selecting points, images, clusters and pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..functions import quat as Q
from ..functions import vec as V
from ..model import Recon
from ..session import cut
from .knn import nearest_neighbor_distances
from .skew import exact_quantiles, global_rank, self_pairs

HEAVY_TRACK = 64


def is_infinite(w: str = "w") -> Column:
    return F.col(w) == 0.0


def keep_points(recon: Recon, kept: DataFrame, renumber: bool = False) -> Recon:
    """Restrict points to ``kept`` (point_id) and observations to those points.

    With ``renumber`` ids become 0..n-1 in id order and ``old_point_id`` keeps the source.
    """
    points = recon.points.join(kept.select("point_id"), "point_id", "left_semi")
    obs = recon.obs.join(kept.select("point_id"), "point_id", "left_semi")
    if renumber:
        mapping = global_rank(points.select("point_id"), ["point_id"], out="new_id")
        points = _renumber(points, mapping)
        obs = _renumber(obs, mapping)
    return recon.with_(points=points, obs=obs)


def _renumber(df: DataFrame, mapping: DataFrame, col: str = "point_id") -> DataFrame:
    return (
        df.join(mapping, col)
        .withColumnRenamed(col, f"old_{col}")
        .withColumnRenamed("new_id", col)
    )


def subset_images(recon: Recon, chosen: DataFrame, drop_orphans: bool = True) -> Recon:
    """Keep the images of ``chosen`` (image_id, ord); new image ids follow ``ord``.

    Points left without observations go too (unless kept on request); both id
    spaces are renumbered densely and the old ids stay as ``old_*``.
    """
    image_map = global_rank(chosen, ["ord", "image_id"], out="new_id").select("image_id", "new_id")
    images = _renumber(recon.images, image_map, "image_id")
    obs = _renumber(recon.obs, image_map, "image_id")
    points = recon.points
    if drop_orphans:
        points = points.join(obs.select("point_id").distinct(), "point_id", "left_semi")
    point_map = global_rank(points.select("point_id"), ["point_id"], out="new_id")
    return recon.with_(images=images, points=_renumber(points, point_map), obs=_renumber(obs, point_map))


def longer_tracks(obs: DataFrame, max_size: int) -> DataFrame:
    """Points observed by more than ``max_size`` images: (point_id, n)."""
    return (
        obs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_size)
    )


def rays(obs: DataFrame, points: DataFrame, centers: DataFrame) -> DataFrame:
    """Unit rays from each observing camera to its finite point: (point_id, image_id, dx, dy, dz)."""
    p = points.filter(F.col("w") != 0.0).select(
        "point_id", *[(F.col(c) / F.col("w")).alias(f"p{c}") for c in "xyz"]
    )
    j = (
        obs.select("point_id", "image_id")
        .join(p, "point_id")
        .join(centers.select("image_id", "cx", "cy", "cz"), "image_id")
    )
    d = V.sub(V.vec("px", "py", "pz"), V.vec("cx", "cy", "cz"))
    j = j.withColumn("_n", V.norm(d)).filter(F.col("_n") > 1e-12)
    return j.select("point_id", "image_id", *[(c / F.col("_n")).alias(a) for c, a in zip(d, ("dx", "dy", "dz"))])


def max_viewing_angles(ray_df: DataFrame) -> DataFrame:
    """Largest angle between any two rays of a point: (point_id, max_angle), points with >= 2 rays.

    Tracks of more than ``HEAVY_TRACK`` rays first lose every ray that provably
    cannot end the widest pair: with R the largest angle to the mean direction
    and L the largest angle from the ray found there, both ends of the widest
    pair lie at least L - R from the mean.
    """
    ray_df = cut(ray_df)
    stats = ray_df.groupBy("point_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dx").alias("mx"), F.sum("dy").alias("my"), F.sum("dz").alias("mz")
    )
    heavy = stats.filter(F.col("n") > HEAVY_TRACK)
    ray_df = ray_df.join(heavy.select("point_id"), "point_id", "left_anti").unionByName(_outer_rays(ray_df, heavy))
    pairs = self_pairs(ray_df, ["point_id"], "image_id")
    cosine = V.dot(V.vec("a_dx", "a_dy", "a_dz"), V.vec("b_dx", "b_dy", "b_dz"))
    return pairs.groupBy("point_id").agg(F.acos(V.clamp_cos(F.min(cosine))).alias("max_angle"))


def _outer_rays(ray_df: DataFrame, heavy: DataFrame) -> DataFrame:
    d, m = V.vec("dx", "dy", "dz"), V.vec("mx", "my", "mz")
    off = F.acos(V.clamp_cos(V.dot(d, m) / F.greatest(V.norm(m), F.lit(1e-300))))
    spread = cut(ray_df.join(heavy.drop("n"), "point_id").withColumn("off", off))
    rim = spread.groupBy("point_id").agg(
        F.max("off").alias("big_r"), F.max_by(F.struct("dx", "dy", "dz"), F.struct("off", "image_id")).alias("far")
    )
    to_far = F.acos(V.clamp_cos(V.dot(d, V.vec("far.dx", "far.dy", "far.dz"))))
    reach = spread.join(rim, "point_id").groupBy("point_id").agg(
        F.max("big_r").alias("big_r"), F.max(to_far).alias("low")
    )
    return (
        spread.join(reach, "point_id")
        .filter(F.col("off") >= F.col("low") - F.col("big_r") - 1e-6)
        .select(*ray_df.columns)
    )


def wide_tracks(points: DataFrame, angles: DataFrame, min_angle: float) -> DataFrame:
    """Points whose widest ray pair spans at least ``min_angle``; infinity points pass."""
    return (
        points.join(angles, "point_id", "left")
        .filter(is_infinite() | (F.col("max_angle") >= min_angle))
        .select("point_id")
    )


def not_isolated(points: DataFrame, factor: float, percentile: float = 50.0) -> DataFrame:
    """Points whose nearest neighbour is within ``factor`` x the given percentile; infinity passes."""
    finite = points.filter(~is_infinite()).select(
        "point_id", F.array(*[F.col(c) / F.col("w") for c in "xyz"]).alias("xyz")
    )
    # Used for the threshold and against it; the search is made once.
    nn = cut(nearest_neighbor_distances(finite, "point_id", "xyz"))
    limit = exact_quantiles(nn, [], "dist", {"ref": percentile / 100.0}).select(
        (F.col("ref") * factor).alias("limit")
    )
    # One row: the global threshold.
    near = nn.join(F.broadcast(limit), F.col("dist") <= F.col("limit")).select("point_id")
    return near.unionByName(points.filter(is_infinite()).select("point_id"))


def small_features(obs: DataFrame, sizes: DataFrame, max_size: float) -> DataFrame:
    """Points whose largest observed feature is at most ``max_size``: (point_id, max_size).
    A feature is known by its image and its index there."""
    return (
        obs.join(sizes.select("image_id", "feature_index", "size"), ["image_id", "feature_index"])
        .groupBy("point_id")
        .agg(F.max("size").alias("max_size"))
        .filter(F.col("max_size") <= max_size)
    )


def by_reprojection_error(points: DataFrame, limit: float) -> DataFrame:
    return points.filter(F.col("error") <= limit)


def by_patch_size(patches: DataFrame, id_col: str, half_u: str, half_v: str, multiplier: float) -> DataFrame:
    """Patches no larger than ``multiplier`` x the median of sqrt(hu hv)."""
    sized = patches.withColumn("extent", F.sqrt(F.col(half_u) * F.col(half_v)))
    limit = exact_quantiles(sized, [], "extent", {"m": 0.5}).select((F.col("m") * multiplier).alias("limit"))
    # One row: the global threshold.
    return sized.join(F.broadcast(limit), F.col("extent") <= F.col("limit")).select(id_col, "extent")


def by_localizability(scores: DataFrame, sigma: str, limit: float) -> DataFrame:
    """Drop only points scored worse than ``limit``; unscored (NaN or NULL) points stay."""
    s = F.col(sigma)
    return scores.filter(s.isNull() | F.isnan(s) | (s <= limit))


def images_in_range(images: DataFrame, expr: str, include: bool = True) -> DataFrame:
    """Unnumbered images are dropped on include and kept on exclude."""
    hit = naming.in_range(naming.file_number("name"), expr)
    return images.filter(hit if include else ~hit)


def images_matching(images: DataFrame, pattern: str, include: bool = True) -> DataFrame:
    hit = naming.glob_match("name", pattern)
    return images.filter(hit if include else ~hit)


def select_clusters(
    members: DataFrame, images: DataFrame | None = None, accepted: tuple[str, ...] | None = None, min_span: int = 2
) -> DataFrame:
    """Accepted members of clusters spanning enough images, clusters renumbered densely."""
    kept = members
    if accepted is not None:
        kept = kept.filter(F.col("status").isin(*accepted))
    if images is not None:
        kept = kept.join(images.select("image_id").distinct(), "image_id", "left_semi")
    span = (
        kept.select("cluster_id", "image_id").distinct()
        .groupBy("cluster_id").agg(F.count(F.lit(1)).alias("span"))
        .filter(F.col("span") >= min_span)
    )
    ids = global_rank(span, ["cluster_id"], out="new_cluster_id")
    return kept.join(ids, "cluster_id")


def worst_consistency(members: DataFrame) -> DataFrame:
    """Largest finite consistency per cluster, +infinity where none is finite."""
    c = F.col("consistency").cast("double")
    finite = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return members.groupBy("cluster_id").agg(
        F.coalesce(F.max(finite), F.lit(float("inf"))).alias("worst_consistency")
    )


def prune_image_pairs(
    pairs: DataFrame, close: int = 4, max_close: int | None = None, max_distant: int = 5000, search: int = 3
) -> DataFrame:
    """Close pairs by index distance plus the best-scored of the nearest distant ones."""
    p = pairs.withColumn("gap", F.abs(F.col("j") - F.col("i")))
    near = p.filter(F.col("gap") <= close).orderBy("gap", "i", "j")
    if max_close is not None:
        near = near.limit(max_close)
    far = (
        p.filter(F.col("gap") > close)
        .orderBy("gap", "i", "j").limit(max_distant * search)
        .orderBy(F.desc("score"), "gap", "i", "j").limit(max_distant)
    )
    return near.withColumn("kind", F.lit("close")).unionByName(far.withColumn("kind", F.lit("distant")))


def near_images(centers: DataFrame, reference: str, count: int | None = None, radius: float | None = None) -> DataFrame:
    """Source images around a named one: the nearest ``count`` or all within ``radius``."""
    ref = centers.filter(F.col("name") == reference).select(*[F.col(c).alias(f"r{c}") for c in ("cx", "cy", "cz")]).limit(1)
    d = V.norm(V.sub(V.vec("cx", "cy", "cz"), V.vec("rcx", "rcy", "rcz")))
    # One row: the reference camera.
    near = centers.join(F.broadcast(ref), F.lit(True)).select("image_id", "name", d.alias("dist"))
    if radius is not None:
        near = near.filter(F.col("dist") <= radius)
    if count is not None:
        near = near.orderBy("dist", "image_id").limit(count)
    return near


def in_frustum(q: Q.Quat, t: V.Vec, p: V.Vec, fx, fy, cx, cy, width, height, near, far) -> Column:
    """Point inside the six planes of a pinhole view volume (camera looks down -Z)."""
    x, y, z = Q.to_camera(q, t, p)
    depth = -z
    u, v = fx * x, -(fy * y)
    return (
        (depth >= near) & (depth <= far)
        & (u >= -cx * depth) & (u <= (width - cx) * depth)
        & (v >= -cy * depth) & (v <= (height - cy) * depth)
    )


def drop_grazing(rays_with_normals: DataFrame, max_obliquity_deg: float) -> DataFrame:
    """Observations seen no flatter than the given angle from the surface normal."""
    cosine = F.abs(V.dot(V.vec("dx", "dy", "dz"), V.vec("nx", "ny", "nz")))
    return rays_with_normals.filter(cosine >= math.cos(math.radians(max_obliquity_deg)))


def best_images_first(pairs: DataFrame, image: int) -> DataFrame:
    """Partners of one image by shared count, ties by id."""
    other = F.when(F.col("i") == image, F.col("j")).otherwise(F.col("i"))
    return (
        pairs.filter((F.col("i") == image) | (F.col("j") == image))
        .select(other.alias("image_id"), "shared")
        .orderBy(F.desc("shared"), "image_id")
    )


def top_partners(pairs: DataFrame, k: int, score: str, ascending: bool = False) -> DataFrame:
    """The k best partners of every image: (image_id, partner, score, rank)."""
    both = pairs.select(F.col("i").alias("image_id"), F.col("j").alias("partner"), score).unionByName(
        pairs.select(F.col("j").alias("image_id"), F.col("i").alias("partner"), score)
    )
    order = F.col(score).asc() if ascending else F.col(score).desc()
    w = Window.partitionBy("image_id").orderBy(order, "partner")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
