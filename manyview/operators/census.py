"""Census of clusters that bridge groups of images: how many contradict the poses that join them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import stats
from ..functions import vec as V
from ..session import cut
from . import filters, triangulation
from .skew import exact_quantiles, self_pairs

#: Residual of a point that lies behind a camera.
INVALID_RESIDUAL = 1e6


@dataclass(frozen=True)
class CensusParams:
    """Satisfying residual in pixels, parallax in degrees that pins a depth, percentile of the warp that
    satisfied clusters reach, z of the confidence bound."""

    sat_px: float = 2.0
    hi_parallax: float = 5.0
    warp_percentile: float = 95.0
    wilson_z: float = 1.96


def placed_clusters(obs: DataFrame, warp: DataFrame, params: CensusParams = CensusParams()) -> DataFrame:
    """(cluster_id, n, median_residual, parallax, warp, measurable, satisfied, eligible) at the candidate poses.

    obs (cluster_id, image_id, u, v, fx, fy, ppx, ppy, pose, cx, cy, cz, dx, dy, dz): pixels, intrinsics without
    distortion, camera centre and unit world ray. warp (cluster_id, warp). A cluster is measurable with two
    rays, a finite point and a median residual; eligible if its warp is within the percentile of
    the satisfied ones'. Null and NaN warps are never eligible.
    """
    rays = obs.select(F.col("cluster_id").alias("track"), "image_id", "cx", "cy", "cz", "dx", "dy", "dz")
    solved = cut(triangulation.triangulate(rays).select(F.col("track").alias("cluster_id"), "px", "py", "pz"))
    j = obs.join(solved, "cluster_id")
    at = Q.to_camera(Q.quat("qw", "qx", "qy", "qz"), V.vec("tx", "ty", "tz"), V.vec("px", "py", "pz"))
    j = j.select("cluster_id", "u", "v", "fx", "fy", "ppx", "ppy", *[c.alias(f"_{n}") for c, n in zip(at, "xyz")])
    du = F.col("fx") * F.col("_x") / -F.col("_z") + F.col("ppx") - F.col("u")
    dv = F.col("fy") * F.col("_y") / F.col("_z") + F.col("ppy") - F.col("v")
    residual = F.when(F.col("_z") < 0, F.sqrt(du * du + dv * dv)).otherwise(INVALID_RESIDUAL)
    med = j.select("cluster_id", residual.alias("r")).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.median("r").alias("median_residual"))
    seen = obs.select("cluster_id", "image_id", "cx", "cy", "cz").join(solved, "cluster_id")
    off = V.sub(V.vec("px", "py", "pz"), V.vec("cx", "cy", "cz"))
    seen = seen.select(F.col("cluster_id").alias("point_id"), "image_id", *[c.alias(f"_{n}") for c, n in zip(off, "xyz")], V.norm(off).alias("_n")).filter("_n > 0")
    angle = filters.max_viewing_angles(seen.select("point_id", "image_id", *[(F.col(f"_{n}") / F.col("_n")).alias(f"d{n}") for n in "xyz"]))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    out = med.join(solved, "cluster_id").join(angle.select(F.col("point_id").alias("cluster_id"), F.degrees("max_angle").alias("parallax")), "cluster_id", "left")
    out = out.join(warp.select("cluster_id", "warp"), "cluster_id", "left")
    measurable = (F.col("n") >= 2) & finite("px") & finite("py") & finite("pz") & finite("median_residual")
    out = cut(out.withColumn("measurable", measurable).withColumn("satisfied", F.col("median_residual") < params.sat_px).drop("px", "py", "pz"))
    limit = exact_quantiles(out.filter(F.col("measurable") & F.col("satisfied") & finite("warp")), [], "warp", {"q": params.warp_percentile / 100.0}).first()
    within = F.col("warp") <= F.lit(float(limit["q"])) if limit is not None and limit["q"] is not None else F.lit(True)
    return out.withColumn("eligible", finite("warp") & within)


def cluster_census(obs: DataFrame, warp: DataFrame, groups: DataFrame, params: CensusParams = CensusParams()) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups with the evidence against their joint pose, and the satisfied share of all clusters.

    groups (image_id, group_id). First (group_a, group_b, n_eligible_hi, n_unsatisfied_hi, wilson_lb) over the
    measurable clusters that have members in both; only eligible ones of enough parallax count.
    Second one row (n_eligible, n_satisfied, sat_pct).
    """
    placed = cut(placed_clusters(obs, warp, params))
    spans = obs.select("cluster_id", "image_id").join(groups, "image_id").select("cluster_id", "group_id").distinct()
    counts = F.coalesce(F.col("eligible") & (F.col("parallax") >= params.hi_parallax), F.lit(False))
    live = placed.filter("measurable").select("cluster_id", counts.alias("counts"), (counts & ~F.col("satisfied")).alias("against"))
    met = self_pairs(spans, ["cluster_id"], "group_id").join(live, "cluster_id")
    pairs = met.groupBy(F.col("a_group_id").alias("group_a"), F.col("b_group_id").alias("group_b")).agg(
        F.sum(F.col("counts").cast("long")).alias("n_eligible_hi"), F.sum(F.col("against").cast("long")).alias("n_unsatisfied_hi")
    )
    pairs = pairs.withColumn("wilson_lb", stats.wilson_lower_bound(F.col("n_unsatisfied_hi"), F.col("n_eligible_hi"), params.wilson_z))
    fine = placed.filter(F.col("measurable") & F.col("eligible")).agg(
        F.count(F.lit(1)).alias("n_eligible"), F.coalesce(F.sum(F.col("satisfied").cast("long")), F.lit(0)).alias("n_satisfied")
    )
    share = F.when(F.col("n_eligible") > 0, 100.0 * F.col("n_satisfied") / F.col("n_eligible")).otherwise(0.0)
    return pairs, fine.withColumn("sat_pct", share)
