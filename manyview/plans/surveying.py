"""Census of bridging clusters on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import vec as V
from ..operators import census, metrics
from ..session import cut
from . import roles
from .posing import NOISY_SQL, QN, TN
from .registry import query, r6

GROUPS = 4
SCENE = (roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL)
#: Pixels of slightly displaced points in front of the cameras; a cluster is a point.
OBS_SQL = """
seen AS (SELECT o.point_id AS track, o.image_id, p.x + o.residual AS wx, p.y - o.residual * 0.5 AS wy, p.z + o.residual * 0.25 AS wz, q.*, c.cx, c.cy, c.cz
  FROM obs o JOIN points p USING (point_id) JOIN poses q ON q.image_id = o.image_id JOIN centers c ON c.image_id = o.image_id WHERE p.w <> 0),
co AS (SELECT track, image_id, cx, cy, cz, r00, r01, r02, r10, r11, r12, r20, r21, r22, tx, ty, tz, 500.0 + 10 * camera_id AS f, wx - cx AS ax, wy - cy AS ay, wz - cz AS az,
    r00 * wx + r01 * wy + r02 * wz + tx AS lx, r10 * wx + r11 * wy + r12 * wz + ty AS ly, -(r20 * wx + r21 * wy + r22 * wz + tz) AS depth FROM seen),
cu AS (SELECT *, f * lx / depth + 500.0 AS u, 400.0 - f * ly / depth AS v FROM co WHERE depth > 0.5),
ry AS (SELECT track, image_id, cx, cy, cz, ax / n AS dx, ay / n AS dy, az / n AS dz FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n FROM cu))
"""
CENSUS_SQL = f"""
back AS (SELECT cu.*, px, py, pz, r00 * px + r01 * py + r02 * pz + tx AS bx, r10 * px + r11 * py + r12 * pz + ty AS by_, -(r20 * px + r21 * py + r22 * pz + tz) AS bd FROM cu JOIN sol USING (track)),
res AS (SELECT track, CASE WHEN bd > 0 THEN sqrt((f * bx / bd + 500.0 - u) ** 2 + (400.0 - f * by_ / bd - v) ** 2) ELSE 1e6 END AS r FROM back),
med AS (SELECT track, count(*) AS n, median(r) AS med FROM res GROUP BY 1),
un AS (SELECT track, image_id, (px - cx) / l AS dx, (py - cy) / l AS dy, (pz - cz) / l AS dz FROM (SELECT *, sqrt((px - cx) ** 2 + (py - cy) ** 2 + (pz - cz) ** 2) AS l FROM back)),
par AS (SELECT track, degrees(acos(greatest(-1.0, least(1.0, min(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz))))) AS parallax FROM un a JOIN un b USING (track) WHERE a.image_id < b.image_id GROUP BY 1),
cl AS (SELECT track, n, med, parallax, (track % 100) / 100.0::DOUBLE AS warp FROM med JOIN par USING (track)),
lim AS (SELECT quantile_cont(warp, 0.95) AS q FROM cl WHERE med < 2.0),
el AS (SELECT cl.*, warp <= coalesce(q, 1e300) AS eligible, med < 2.0 AS satisfied FROM cl, lim),
sp AS (SELECT DISTINCT track, image_id % {GROUPS} AS g FROM cu)
"""


def _observations(spark, sf):
    o = roles.obs(spark, sf).select("point_id", "image_id", "residual")
    p = roles.points(spark, sf).filter("w <> 0").select("point_id", "x", "y", "z")
    im = metrics.with_centers(roles.images(spark, sf)).select("image_id", (500.0 + 10 * F.col("camera_id")).alias("fx"), *QN, *TN, "cx", "cy", "cz")
    e = F.col("residual")
    j = o.join(p, "point_id").join(im, "image_id").withColumns({"wx": F.col("x") + e, "wy": F.col("y") - e * 0.5, "wz": F.col("z") + e * 0.25})
    at = Q.to_camera(Q.quat(*QN), V.vec(*TN), V.vec("wx", "wy", "wz"))
    j = j.select("*", *[c.alias(f"l{n}") for c, n in zip(at, "xyz")]).withColumn("depth", -F.col("lz")).filter("depth > 0.5")
    off = V.sub(V.vec("wx", "wy", "wz"), V.vec("cx", "cy", "cz"))
    j = j.select("*", *[c.alias(f"a{n}") for c, n in zip(off, "xyz")], V.norm(off).alias("n"))
    return cut(j.select(
        F.col("point_id").alias("cluster_id"), "image_id", (F.col("fx") * F.col("lx") / F.col("depth") + 500.0).alias("u"),
        (400.0 - F.col("fx") * F.col("ly") / F.col("depth")).alias("v"), "fx", F.col("fx").alias("fy"), F.lit(500.0).alias("ppx"), F.lit(400.0).alias("ppy"),
        *QN, *TN, "cx", "cy", "cz", *[(F.col(f"a{n}") / F.col("n")).alias(f"d{n}") for n in "xyz"],
    ))


def _census(spark, sf):
    obs = _observations(spark, sf)
    warp = obs.select("cluster_id").distinct().withColumn("warp", (F.col("cluster_id") % 100) / 100.0)
    groups = roles.images(spark, sf).select("image_id", (F.col("image_id") % GROUPS).alias("group_id"))
    return census.cluster_census(obs, warp, groups)


_SOLVE = NOISY_SQL[NOISY_SQL.index("sums AS") :]


@query(
    "cluster_census",
    roles.sql(
        *SCENE, OBS_SQL, _SOLVE, CENSUS_SQL,
        body="""
        , pc AS (SELECT a.g AS group_a, b.g AS group_b, count(*) FILTER (WHERE eligible AND parallax >= 5.0) AS n, count(*) FILTER (WHERE eligible AND parallax >= 5.0 AND NOT satisfied) AS k
                 FROM sp a JOIN sp b ON a.track = b.track AND a.g < b.g JOIN el ON el.track = a.track GROUP BY 1, 2)
        SELECT group_a::BIGINT AS group_a, group_b::BIGINT AS group_b, n AS n_eligible_hi, k AS n_unsatisfied_hi,
          CASE WHEN n > 0 THEN round(greatest((k / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 0), 9) ELSE 0.0 END AS wilson_lb FROM pc
        """,
    ),
)
def cluster_census(spark, sf):
    """Per pair of image groups: bridging clusters that could contradict the poses, those that do, and the bound of their share."""
    pairs, _ = _census(spark, sf)
    return pairs.select("group_a", "group_b", "n_eligible_hi", "n_unsatisfied_hi", r6("wilson_lb", "wilson_lb", 9))


@query(
    "cluster_satisfaction",
    roles.sql(
        *SCENE, OBS_SQL, _SOLVE, CENSUS_SQL,
        body="""SELECT count(*) AS n_eligible, count(*) FILTER (WHERE satisfied) AS n_satisfied, round(100.0 * count(*) FILTER (WHERE satisfied) / count(*), 6)::DOUBLE AS sat_pct FROM el WHERE eligible""",
    ),
)
def cluster_satisfaction(spark, sf):
    """Share of the eligible clusters that the poses satisfy."""
    _, fine = _census(spark, sf)
    return fine.select("n_eligible", "n_satisfied", r6("sat_pct", "sat_pct"))
