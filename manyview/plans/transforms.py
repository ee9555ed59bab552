"""Steps for ``Recon.transform``: each takes a reconstruction and returns a new one.

    recon.transform(remove_short_tracks(2), rotate((0, 0, 1), 0.5), include_range("1-100"))

Steps only build lazy tables, apart from the iterative ones their operators name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import camera
from ..model import Recon
from ..operators import align, filters, matching, metrics

Step = Callable[[Recon], Recon]


def _keep(select) -> Step:
    return lambda recon: filters.keep_points(recon, select(recon))


def remove_short_tracks(max_size: int) -> Step:
    return _keep(lambda r: filters.longer_tracks(r.obs, max_size))


def remove_narrow_tracks(min_angle_rad: float) -> Step:
    def select(r: Recon):
        rays = filters.rays(r.obs, r.points, metrics.with_centers(r.images))
        return filters.wide_tracks(r.points, filters.max_viewing_angles(rays), min_angle_rad)

    return _keep(select)


def remove_isolated_points(factor: float, percentile: float = 50.0) -> Step:
    return _keep(lambda r: filters.not_isolated(r.points, factor, percentile))


def remove_large_features(max_size: float) -> Step:
    """Needs ``features`` (image_id, feature_index, size)."""
    def select(r: Recon):
        j = r.obs.join(r.features.select("image_id", "feature_index", "size"), ["image_id", "feature_index"])
        return j.groupBy("point_id").agg(F.max("size").alias("m")).filter(F.col("m") <= max_size)

    return _keep(select)


def filter_by_reprojection_error(limit: float) -> Step:
    return _keep(lambda r: filters.by_reprojection_error(r.points, limit))


def _images(select) -> Step:
    def step(recon: Recon) -> Recon:
        chosen = select(recon.images).select("image_id", F.col("image_id").alias("ord"))
        return filters.subset_images(recon, chosen)

    return step


def include_range(expr: str) -> Step:
    return _images(lambda im: filters.images_in_range(im, expr))


def exclude_range(expr: str) -> Step:
    return _images(lambda im: filters.images_in_range(im, expr, include=False))


def include_glob(pattern: str) -> Step:
    return _images(lambda im: filters.images_matching(im, pattern))


def exclude_glob(pattern: str) -> Step:
    return _images(lambda im: filters.images_matching(im, pattern, include=False))


def similarity(sim: align.Similarity) -> Step:
    return lambda recon: align.transform_recon(recon, sim)


def rotate(axis, angle_rad: float) -> Step:
    return similarity(align.Similarity.from_axis_angle(axis, angle_rad))


def translate(offset) -> Step:
    return similarity(align.Similarity.from_axis_angle((0, 0, 1), 0.0, offset))


def scale(factor: float) -> Step:
    return similarity(align.Similarity.from_axis_angle((0, 0, 1), 0.0, scale=factor))


def scale_by_measurements(measures) -> Step:
    def step(recon: Recon) -> Recon:
        s = metrics.measured_scale(measures, recon.points).first()
        return scale(float(s["scale"]))(recon)

    return step


def align_to(target: Recon) -> Step:
    """Move onto the target by the camera centres of the shared images."""
    def step(recon: Recon) -> Recon:
        a, b = metrics.with_centers(recon.images), metrics.with_centers(target.images)
        both = matching.shared_images(a, b)
        s = a.select(F.col("image_id").alias("a_image"), *[F.col(f"c{k}").alias(f"s{k}") for k in "xyz"])
        t = b.select(F.col("image_id").alias("b_image"), *[F.col(f"c{k}").alias(f"t{k}") for k in "xyz"])
        return similarity(align.fit_similarity(both.join(s, "a_image").join(t, "b_image")))(recon)

    return step


def switch_camera_model(target: str) -> Step:
    return lambda recon: recon.with_(cameras=camera.switch_model(recon.cameras, target))
