"""Identifiers, conventions and patch geometry on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convention, features, naming
from ..functions import quat as Q
from ..functions import vec as V
from ..operators import metrics
from ..sources import matchdb
from . import roles
from .posing import QN, TN
from .registry import query, r6


@query(
    "pair_decode",
    f"""
    WITH p AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS i, greatest(l_suppkey, l_partkey) AS j, l_linenumber AS code FROM lineitem)
    SELECT i * {matchdb.PAIR_BASE} + j AS pair_id, i, j, {list(matchdb.CONFIGS)!r}[code + 1] AS config FROM p
    """,
)
def pair_decode(spark, sf):
    """Pair ids of a match database and what they stand for."""
    li = roles.table(spark, sf, "lineitem")
    p = li.select(matchdb.pair_id(F.col("l_suppkey"), F.col("l_partkey")).alias("pair_id"), F.col("l_linenumber").alias("code")).distinct()
    i, j = matchdb.pair_images(F.col("pair_id"))
    return p.select("pair_id", i.alias("i"), j.alias("j"), matchdb.config_name(F.col("code")).alias("config"))


@query(
    "rotation_interpolation",
    roles.sql(
        roles.IMAGES_SQL,
        body="""
        , n AS (SELECT a.image_id, a.qw AS aw, a.qx AS ax, a.qy AS ay, a.qz AS az, s * b.qw AS bw, s * b.qx AS b1, s * b.qy AS b2, s * b.qz AS b3, abs(d) AS d
                FROM (SELECT a.image_id AS k, a.qw * b.qw + a.qx * b.qx + a.qy * b.qy + a.qz * b.qz AS d, CASE WHEN a.qw * b.qw + a.qx * b.qx + a.qy * b.qy + a.qz * b.qz < 0 THEN -1.0 ELSE 1.0 END AS s
                      FROM images a JOIN images b ON b.image_id = a.image_id + 1) p JOIN images a ON a.image_id = k JOIN images b ON b.image_id = k + 1),
        w AS (SELECT *, sin(0.7 * acos(least(1.0, d))) AS wa, sin(0.3 * acos(least(1.0, d))) AS wb FROM n),
        m AS (SELECT image_id, aw * wa + bw * wb AS w, ax * wa + b1 * wb AS x, ay * wa + b2 * wb AS y, az * wa + b3 * wb AS z FROM w)
        SELECT image_id, round(w / l, 5) AS qw, round(x / l, 5) AS qx, round(y / l, 5) AS qy, round(z / l, 5) AS qz FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM m)
        """,
    ),
)
def rotation_interpolation(spark, sf):
    """Orientation three tenths of the way to the next image."""
    im = roles.images(spark, sf)
    a = im.select("image_id", *[F.col(c).alias(f"a_{c}") for c in QN])
    b = im.select((F.col("image_id") - 1).alias("image_id"), *[F.col(c).alias(f"b_{c}") for c in QN])
    q = Q.slerp(Q.quat(*[f"a_{c}" for c in QN]), Q.quat(*[f"b_{c}" for c in QN]), F.lit(0.3))
    return a.join(b, "image_id").select("image_id", *[r6(c, n, 5) for c, n in zip(q, QN)])


@query(
    "camera_flips",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL,
        body="""
        SELECT image_id, round(r00, 6) + 0.0 AS f00, round(-r10, 6) + 0.0 AS f10, round(-r21, 6) + 0.0 AS f21, round(r00, 6) + 0.0 AS s00, round(-r01, 6) + 0.0 AS s01, round(r22, 6) + 0.0 AS s22,
               round(r00, 6) + 0.0 AS b00, round(r12, 6) + 0.0 AS b12, round(tx, 6) + 0.0 AS tx, round(-ty, 6) + 0.0 AS ty, round(tz, 6) + 0.0 AS tz FROM poses
        """,
    ),
)
def camera_flips(spark, sf):
    """Camera flip, flipped relative pose, and a conversion there and back."""
    q, t = Q.quat(*QN), V.vec(*TN)
    flipped, ft = convention.flip_camera(q, t)
    both, _ = convention.relative_pose(q, t)
    back, bt = convention.pose_to_theirs(*convention.pose_to_ours(q, t))
    f, s, b = Q.matrix(flipped), Q.matrix(both), Q.matrix(back)
    entries = [(f[0][0], "f00"), (f[1][0], "f10"), (f[2][1], "f21"), (s[0][0], "s00"), (s[0][1], "s01"), (s[2][2], "s22"), (b[0][0], "b00"), (b[1][2], "b12")]
    moves = [(bt[0], "tx"), (ft[1], "ty"), (bt[2], "tz")]
    return roles.images(spark, sf).select("image_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in entries + moves])


@query(
    "world_axes",
    roles.sql(
        roles.POINTS_SQL,
        body="SELECT point_id, round(x, 6) AS ours_x, round(z, 6) AS ours_y, round(-y, 6) + 0.0 AS ours_z, round(-z, 6) + 0.0 AS theirs_y, round(y, 6) AS theirs_z FROM points",
    ),
)
def world_axes(spark, sf):
    p = V.vec("x", "y", "z")
    ours, theirs = convention.world_to_ours(p), convention.world_to_theirs(p)
    return roles.points(spark, sf).select(
        "point_id", r6(ours[0], "ours_x"), r6(ours[1], "ours_y"), (F.round(ours[2], 6) + 0.0).alias("ours_z"), (F.round(theirs[1], 6) + 0.0).alias("theirs_y"), r6(theirs[2], "theirs_z")
    )


@query(
    "patch_corners",
    roles.sql(
        *(roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL),
        body="""
        , p AS (SELECT point_id, image_id, x, y, z, error + 0.1 AS ux, 0.2::DOUBLE AS uy, 0.0::DOUBLE AS uz, 0.1::DOUBLE AS vx, 0.3::DOUBLE AS vy, error + 0.2 AS vz
                FROM points JOIN (SELECT point_id, image_id FROM obs) USING (point_id) WHERE w <> 0),
        n AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM p)
        SELECT point_id, image_id, round(x + ux - vx, 6) AS x, round(y + uy - vy, 6) AS y, round(z + uz - vz, 6) AS z,
               nx * (cx - x) + ny * (cy - y) + nz * (cz - z) > 0 AS front FROM n JOIN centers USING (image_id)
        """,
    ),
)
def patch_corners(spark, sf):
    """A corner of every observed patch, and whether its front is seen."""
    p = roles.points(spark, sf).filter("w <> 0").join(roles.obs(spark, sf).select("point_id", "image_id"), "point_id")
    p = p.join(metrics.with_centers(roles.images(spark, sf)).select("image_id", "cx", "cy", "cz"), "image_id")
    u, v = (F.col("error") + 0.1, F.lit(0.2), F.lit(0.0)), (F.lit(0.1), F.lit(0.3), F.col("error") + 0.2)
    c = V.vec("x", "y", "z")
    corner = features.patch_point(c, u, v, F.lit(1.0), F.lit(-1.0))
    front = features.front_facing(c, features.patch_normal(u, v), V.vec("cx", "cy", "cz"))
    return p.select("point_id", "image_id", *[r6(e, n) for e, n in zip(corner, "xyz")], front.alias("front"))


@query("frame_keys", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) END AS frame FROM pages")
def frame_keys(spark, sf):
    """Paths without their sensor's prefix."""
    return roles.table(spark, sf, "pages").select("page_id", naming.frame_key("url", "https://").alias("frame"))
