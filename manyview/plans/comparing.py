"""Comparison queries: the scene against a changed copy of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.camera import switch_model
from ..operators import compare, matching, metrics
from . import roles
from .matching import SIDES_SQL, _sides
from .registry import query, r6


def _shifted(spark, sf):
    """The same image names carrying the pose of the next image."""
    im = roles.images(spark, sf)
    return im.select((F.col("image_id") - 1).alias("image_id"), *[c for c in im.columns if c not in ("image_id", "name")]).join(
        im.select("image_id", F.replace("name", F.lit("#"), F.lit("/")).alias("name")), "image_id"
    )


@query(
    "compare_extrinsics",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL,
        body="""SELECT a.image_id, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)), 6) AS center_distance,
                       round(degrees(2 * acos(least(1.0, abs(a.qw * b.qw + a.qx * b.qx + a.qy * b.qy + a.qz * b.qz)))), 4) AS rotation_deg
                FROM centers a JOIN centers b ON b.image_id = a.image_id + 1""",
    ),
)
def compare_extrinsics(spark, sf):
    a = roles.images(spark, sf).withColumn("name", F.replace("name", F.lit("#"), F.lit("\\")))
    c = compare.compare_extrinsics(a, _shifted(spark, sf))
    return c.select(F.col("a_image").alias("image_id"), r6("center_distance", "center_distance"), r6("rotation_deg", "rotation_deg", 4))


@query(
    "compare_intrinsics",
    """
    WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS camera_id, n_nationkey % 5 AS kind, CAST(500 + 10 * n_nationkey AS DOUBLE) AS f, 0.01::DOUBLE * (n_regionkey + 1) AS k1, 0.001::DOUBLE * (n_regionkey + 1) AS p1 FROM nation),
    a AS (SELECT camera_id, 'principal_point_x' AS parameter, 500.0::DOUBLE AS v FROM c UNION ALL SELECT camera_id, 'principal_point_y', 400.0 FROM c
          UNION ALL SELECT camera_id, 'focal_length', f FROM c WHERE kind = 1 UNION ALL SELECT camera_id, 'focal_length_x', f FROM c WHERE kind <> 1
          UNION ALL SELECT camera_id, 'focal_length_y', f FROM c WHERE kind <> 1 UNION ALL SELECT camera_id, 'radial_distortion_k1', k1 FROM c WHERE kind IN (1, 2, 3)
          UNION ALL SELECT camera_id, 'tangential_distortion_p1', p1 FROM c WHERE kind = 2),
    b AS (SELECT camera_id, 'principal_point_x' AS parameter, 500.0::DOUBLE AS v FROM c UNION ALL SELECT camera_id, 'principal_point_y', 400.0 FROM c
          UNION ALL SELECT camera_id, 'focal_length', f FROM c UNION ALL SELECT camera_id, 'radial_distortion_k1', CASE WHEN kind IN (1, 2, 3) THEN k1 ELSE 0 END FROM c)
    SELECT camera_id, parameter, round(a.v, 6) AS a_value, round(b.v, 6) AS b_value, round(b.v - a.v, 6) AS difference FROM a FULL JOIN b USING (camera_id, parameter)
    """,
)
def compare_intrinsics(spark, sf):
    """Cameras against themselves after switching to a simpler model."""
    cams = roles.harness_cameras(roles.table(spark, sf, "nation"))
    c = compare.compare_intrinsics(cams, switch_model(cams, "SIMPLE_RADIAL"))
    return c.select("camera_id", "parameter", *[r6(k, k) for k in ("a_value", "b_value", "difference")])


@query(
    "compare_points",
    roles.sql(
        roles.POINTS_SQL, SIDES_SQL,
        body="""
        , v AS (SELECT s.point_id AS s, t.point_id AS t, count(*) AS votes FROM src s JOIN tgt t USING (image_id, feature_index) GROUP BY 1, 2),
        l AS (SELECT s, t FROM v QUALIFY row_number() OVER (PARTITION BY s ORDER BY votes DESC, t) = 1),
        d AS (SELECT sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM l JOIN points p ON p.point_id = s JOIN points q ON q.point_id = t WHERE p.w <> 0 AND q.w <> 0)
        SELECT count(*) AS n, round(min(d), 6) AS min, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(max(d), 6) AS max FROM d
        """,
    ),
)
def compare_points(spark, sf):
    links = matching.resolve_point(*_sides(spark, sf)).select(F.col("point_id").alias("source_point"), "target_point")
    p = roles.points(spark, sf)
    s = metrics.summarize(compare.compare_points(p, p, links), "distance")
    return s.select("n", *[r6(c, c) for c in ("min", "mean", "median", "max")])
