"""Pose, camera, triangulation and alignment queries on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera, convention, naming
from ..functions import quat as Q
from ..functions import vec as V
from ..operators import align, metrics, triangulation
from ..session import cut
from . import roles
from .registry import query, r6

QN, TN = ("qw", "qx", "qy", "qz"), ("tx", "ty", "tz")
SCENE = (roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL)


@query("camera_centers", roles.sql(roles.IMAGES_SQL, roles.CENTERS_SQL, body="SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM centers"))
def camera_centers(spark, sf):
    return metrics.with_centers(roles.images(spark, sf)).select("image_id", *[r6(c, c) for c in ("cx", "cy", "cz")])


@query("view_directions", roles.sql(roles.IMAGES_SQL, roles.CENTERS_SQL, body="SELECT image_id, round(-r20, 6) AS dx, round(-r21, 6) AS dy, round(-r22, 6) AS dz FROM poses"))
def view_directions(spark, sf):
    d = Q.view_direction(Q.quat(*QN))
    return roles.images(spark, sf).select("image_id", *[r6(c, n) for c, n in zip(d, ("dx", "dy", "dz"))])


@query(
    "rotation_angles",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL,
        body="""SELECT image_id, round(degrees(2 * acos(least(1.0, abs(qw)))), 4) AS angle_deg, round(atan2(r21, r22), 6) AS roll,
                       round(-asin(greatest(-1.0, least(1.0, r20))), 6) AS pitch, round(atan2(r10, r00), 6) AS yaw FROM poses""",
    ),
)
def rotation_angles(spark, sf):
    q = Q.quat(*QN)
    e = Q.euler(q)
    return roles.images(spark, sf).select("image_id", r6(F.degrees(Q.angle(q)), "angle_deg", 4), *[r6(c, n) for c, n in zip(e, ("roll", "pitch", "yaw"))])


@query(
    "quaternion_round_trip",
    roles.sql(
        roles.IMAGES_SQL,
        body="""SELECT image_id, round(qw * s, 6) AS qw, round(qx * s, 6) AS qx, round(qy * s, 6) AS qy, round(qz * s, 6) AS qz
                FROM (SELECT *, CASE WHEN qw < 0 THEN -1.0 ELSE 1.0 END AS s FROM images)""",
    ),
)
def quaternion_round_trip(spark, sf):
    m = Q.matrix(Q.quat(*QN))
    names = [f"m{i}{j}" for i in range(3) for j in range(3)]
    staged = roles.images(spark, sf).select("image_id", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    rows = tuple(V.vec(*names[3 * i : 3 * i + 3]) for i in range(3))
    return staged.select("image_id", *[r6(c, n) for c, n in zip(Q.from_matrix(rows), QN)])


SIM = align.Similarity.from_axis_angle((1.0, 2.0, 2.0), 0.7, (1.0, -2.0, 0.5), 1.75)


def _sim_sql(x: str, y: str, z: str) -> tuple[list[str], list[str]]:
    r, t, s = SIM.rotation, SIM.translation, SIM.scale
    rot = ["(" + " + ".join(f"({float(r[i, k])!r}::DOUBLE) * {c}" for k, c in enumerate((x, y, z))) + ")" for i in range(3)]
    return [f"({s}::DOUBLE * {rot[i]} + ({float(t[i])}::DOUBLE))" for i in range(3)], rot


_MOVED, _TURNED = _sim_sql("x", "y", "z")


@query(
    "similarity_points",
    roles.sql(
        roles.POINTS_SQL,
        body="SELECT point_id, " + ", ".join(f"round(CASE WHEN w = 0 THEN {_TURNED[i]} ELSE {_MOVED[i]} END, 6) AS {c}" for i, c in enumerate("xyz")) + " FROM points",
    ),
)
def similarity_points(spark, sf):
    return align.transform_points(roles.points(spark, sf), SIM).select("point_id", *[r6(c, c) for c in "xyz"])


_CM, _ = _sim_sql("cx", "cy", "cz")


@query(
    "similarity_poses",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL,
        body="SELECT image_id, " + ", ".join(f"round({_CM[i]}, 5) AS {c}" for i, c in enumerate(("cx", "cy", "cz"))) + " FROM centers",
    ),
)
def similarity_poses(spark, sf):
    """Camera centres after the move, recovered from the moved poses."""
    moved = cut(align.transform_poses(roles.images(spark, sf), SIM))
    return metrics.with_centers(moved).select("image_id", *[r6(c, c, 5) for c in ("cx", "cy", "cz")])


@query(
    "convention_conversion",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL,
        body="""SELECT image_id, round(r00, 6) AS m00, round(r02, 6) AS m01, round(-r01, 6) AS m02, round(-r10, 6) AS m10, round(-r12, 6) AS m11, round(r11, 6) AS m12,
                       round(tx, 6) AS tx, round(-ty, 6) AS ty, round(-tz, 6) AS tz FROM poses""",
    ),
)
def convention_conversion(spark, sf):
    q, t = convention.pose_to_ours(Q.quat(*QN), V.vec(*TN))
    staged = cut(roles.images(spark, sf).select("image_id", *[c.alias(n) for c, n in zip((*q, *t), (*QN, *TN))]))
    m = Q.matrix(Q.quat(*QN))
    return staged.select(
        "image_id", *[r6(m[i][j] + 0.0, f"m{i}{j}") for i in range(2) for j in range(3)], *[r6(c, c) for c in TN]
    )


CAM_SQL = """
cams AS (SELECT CAST(n_nationkey AS BIGINT) AS camera_id, n_nationkey % 5 AS kind, 500.0 + 10 * n_nationkey AS f, 0.01 * (n_regionkey + 1) AS k1, 0.001 * (n_regionkey + 1) AS p1 FROM nation)
"""
PROJECT_SQL = """
cam_pts AS (
  SELECT o.image_id, o.point_id, o.x AS ox, o.y AS oy, kind, f::DOUBLE AS f, k1::DOUBLE AS k1, CASE WHEN kind = 2 THEN p1::DOUBLE ELSE 0.0::DOUBLE END AS p1,
         r00 * p.x + r01 * p.y + r02 * p.z + tx AS x, r10 * p.x + r11 * p.y + r12 * p.z + ty AS y, r20 * p.x + r21 * p.y + r22 * p.z + tz AS z
  FROM obs o JOIN points p USING (point_id) JOIN poses USING (image_id) JOIN cams USING (camera_id) WHERE p.w <> 0),
norm AS (SELECT *, x / -z AS a, y / z AS b, sqrt(x * x + y * y) AS r, atan2(sqrt(x * x + y * y), -z) AS th, CASE WHEN kind IN (1, 2) THEN k1 ELSE 0.0 END AS kk FROM cam_pts),
dist AS (SELECT *, a * a + b * b AS r2 FROM norm),
pix AS (SELECT image_id, point_id, ox, oy,
    CASE WHEN kind = 4 THEN atan2(x, -z) WHEN kind = 3 THEN x * (th * (1 + k1 * th * th)) / r WHEN z < 0 THEN a * (1 + kk * r2) + 2 * p1 * a * b END * f + 500 AS u,
    CASE WHEN kind = 4 THEN -asin(y / sqrt(x * x + y * y + z * z)) WHEN kind = 3 THEN -y * (th * (1 + k1 * th * th)) / r WHEN z < 0 THEN b * (1 + kk * r2) + p1 * (r2 + 2 * b * b) END * f + 400 AS v
  FROM dist)
"""


def camera_points(spark, sf):
    """Observations with the point in camera coordinates and the camera's model."""
    o = roles.obs(spark, sf).select("image_id", "point_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    p = roles.points(spark, sf).filter("w <> 0").select("point_id", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    cams = roles.harness_cameras(roles.table(spark, sf, "nation"))
    j = o.join(p, "point_id").join(roles.images(spark, sf).drop("name"), "image_id").join(cams, "camera_id")
    c = Q.to_camera(Q.quat(*QN), V.vec(*TN), V.vec("px", "py", "pz"))
    return j.select("image_id", "point_id", "ox", "oy", "model", "params", *[e.alias(n) for e, n in zip(c, ("kx", "ky", "kz"))])


@query(
    "reprojection_residuals",
    roles.sql(
        *SCENE, CAM_SQL, PROJECT_SQL,
        body="""SELECT image_id, point_id, round((u - ox) / (1 + abs(u) + abs(v)), 6) AS du, round((v - oy) / (1 + abs(u) + abs(v)), 6) AS dv FROM pix""",
    ),
)
def reprojection_residuals(spark, sf):
    """Residuals in relation to the projected pixel, which may lie far outside the image."""
    p = camera.with_pixels(camera_points(spark, sf), ("kx", "ky", "kz"))
    size = 1.0 + F.abs("u") + F.abs("v")
    return p.select("image_id", "point_id", r6((F.col("u") - F.col("ox")) / size, "du"), r6((F.col("v") - F.col("oy")) / size, "dv"))


@query(
    "inlier_fraction",
    roles.sql(
        *SCENE, CAM_SQL, PROJECT_SQL,
        body="""SELECT image_id, round(avg(CASE WHEN sqrt((u - ox) * (u - ox) + (v - oy) * (v - oy)) < 300 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM pix GROUP BY 1""",
    ),
)
def inlier_fraction(spark, sf):
    p = camera.with_pixels(camera_points(spark, sf), ("kx", "ky", "kz"))
    j = p.select("image_id", (F.col("u") - F.col("ox")).alias("du"), (F.col("v") - F.col("oy")).alias("dv"))
    near = F.coalesce(F.sqrt(F.col("du") * F.col("du") + F.col("dv") * F.col("dv")) < 300.0, F.lit(False))
    return j.groupBy("image_id").agg(r6(F.avg(near.cast("double")), "fraction"))


@query(
    "pixel_ray_round_trip",
    roles.sql(
        roles.IMAGES_SQL, roles.OBS_SQL,
        body="SELECT image_id, point_id, round(x, 3) AS u, round(y, 3) AS v FROM obs JOIN images USING (image_id)",
    ),
)
def pixel_ray_round_trip(spark, sf):
    """Pixels to rays (iterative inverse) and back through the forward model."""
    cams = roles.harness_cameras(roles.table(spark, sf, "nation"))
    o = roles.obs(spark, sf).select("image_id", "point_id", "x", "y").join(roles.images(spark, sf).select("image_id", "camera_id"), "image_id").join(cams, "camera_id")
    rays = o.withColumn("ray", camera.pixel_ray(F.col("x"), F.col("y"))).select("image_id", "point_id", "model", "params", "ray.*")
    back = camera.with_pixels(rays, ("x", "y", "z"))
    return back.select("image_id", "point_id", r6("u", "u", 3), r6("v", "v", 3))


# Rays to slightly displaced points, so tracks are over-determined.
NOISY_SQL = """
nr AS (SELECT o.point_id AS track, c.cx, c.cy, c.cz, p.x + o.residual - c.cx AS ax, p.y - o.residual * 0.5 - c.cy AS ay, p.z + o.residual * 0.25 - c.cz AS az
       FROM obs o JOIN points p USING (point_id) JOIN centers c USING (image_id) WHERE p.w <> 0),
ry AS (SELECT track, cx, cy, cz, ax / n AS dx, ay / n AS dy, az / n AS dz FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n FROM nr)),
sums AS (SELECT track, count(*) AS n, sum(1 - dx * dx) AS a, sum(-dx * dy) AS b, sum(-dx * dz) AS c, sum(1 - dy * dy) AS d, sum(-dy * dz) AS e, sum(1 - dz * dz) AS f,
                sum(cx - (cx * dx + cy * dy + cz * dz) * dx) AS g, sum(cy - (cx * dx + cy * dy + cz * dz) * dy) AS h, sum(cz - (cx * dx + cy * dy + cz * dz) * dz) AS i FROM ry GROUP BY 1),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM sums WHERE n >= 2),
sol AS (SELECT track, n, a, b, c, d, e, f,
               (g * (d * f - e * e) - b * (h * f - e * i) + c * (h * e - d * i)) / det AS px,
               (a * (h * f - e * i) - g * (b * f - c * e) + c * (b * i - c * h)) / det AS py,
               (a * (d * i - h * e) - b * (b * i - h * c) + g * (b * e - c * d)) / det AS pz FROM det)
"""


def noisy_rays(spark, sf):
    o = roles.obs(spark, sf).select(F.col("point_id").alias("track"), "image_id", "residual")
    p = roles.points(spark, sf).filter("w <> 0").select(F.col("point_id").alias("track"), "x", "y", "z")
    c = metrics.with_centers(roles.images(spark, sf)).select("image_id", "cx", "cy", "cz")
    j = o.join(p, "track").join(c, "image_id")
    e = F.col("residual")
    a = (F.col("x") + e - F.col("cx"), F.col("y") - e * 0.5 - F.col("cy"), F.col("z") + e * 0.25 - F.col("cz"))
    j = j.select("track", "cx", "cy", "cz", *[v.alias(n) for v, n in zip(a, ("ax", "ay", "az"))]).withColumn("n", V.norm(V.vec("ax", "ay", "az")))
    return cut(j.select("track", "cx", "cy", "cz", *[(F.col(f"a{k}") / F.col("n")).alias(f"d{k}") for k in "xyz"]))


@query(
    "triangulation",
    roles.sql(
        *SCENE, NOISY_SQL,
        body="""SELECT sol.track, sol.n, round(px, 4) AS px, round(py, 4) AS py, round(pz, 4) AS pz, round(a + d + f, 6) AS trace,
                       min((px - cx) * dx + (py - cy) * dy + (pz - cz) * dz) > 0 AS in_front
                FROM sol JOIN ry USING (track) GROUP BY sol.track, sol.n, px, py, pz, a, d, f""",
    ),
)
def triangulation_query(spark, sf):
    t = triangulation.triangulate(noisy_rays(spark, sf)).filter("n >= 2")
    return t.select("track", "n", *[r6(c, c, 4) for c in ("px", "py", "pz")], r6(F.col("l0") + F.col("l1") + F.col("l2"), "trace"), "in_front")


UNCERTAIN_SQL = """
mean AS (SELECT track, sx / l AS mx, sy / l AS my, sz / l AS mz, ux, uy, uz FROM (
                   SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM (SELECT track, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz, avg(cx) AS ux, avg(cy) AS uy, avg(cz) AS uz FROM ry GROUP BY 1))),
        wt AS (SELECT ry.*, px, py, pz, mx, my, mz, ux, uy, uz, 1.0 / (((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) * 1e-6::DOUBLE) AS w
               FROM ry JOIN sol USING (track) JOIN mean USING (track)),
        m AS (SELECT track, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, any_value((px - ux) * mx + (py - uy) * my + (pz - uz) * mz) AS depth,
                     sum(w * (1 - dx * dx)) AS a, sum(-w * dx * dy) AS b, sum(-w * dx * dz) AS c, sum(w * (1 - dy * dy)) AS d, sum(-w * dy * dz) AS e, sum(w * (1 - dz * dz)) AS f,
                     avg((cx - ux) * (cx - ux) + (cy - uy) * (cy - uy) + (cz - uz) * (cz - uz)
                         - ((cx - ux) * mx + (cy - uy) * my + (cz - uz) * mz) * ((cx - ux) * mx + (cy - uy) * my + (cz - uz) * mz)) AS perp2
              FROM wt GROUP BY 1),
        v AS (SELECT *, (mx * mx * (d * f - e * e) + my * my * (a * f - c * c) + mz * mz * (a * d - b * b)
                         + 2 * (mx * my * (c * e - b * f) + mx * mz * (b * e - c * d) + my * mz * (b * c - a * e)))
                        / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) AS var FROM m)
"""


@query(
    "depth_uncertainty",
    roles.sql(
        *SCENE, NOISY_SQL, UNCERTAIN_SQL,
        body="""
        SELECT track, round(depth, 4) AS depth, round(sqrt(var), 4) AS depth_sigma, round(2 * sqrt(greatest(perp2, 0.0)) / 1e-3::DOUBLE, 2) AS resolvable_distance FROM v
        """,
    ),
)
def depth_uncertainty(spark, sf):
    rays = noisy_rays(spark, sf).withColumn("sigma", F.lit(1e-3))
    solved = cut(triangulation.triangulate(rays).filter("n >= 2"))
    d = triangulation.depth_uncertainty(rays, solved)
    return d.select("track", r6("depth", "depth", 4), r6("depth_sigma", "depth_sigma", 4), r6("resolvable_distance", "resolvable_distance", 2))


# Eigenvalue ratio of the 3 x 3 solve in closed form.
CONDITION_SQL = """
e1 AS (SELECT *, (a + d + f) / 3 AS q FROM sol),
e2 AS (SELECT *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6) AS p FROM e1),
e3 AS (SELECT *, acos(greatest(-1.0, least(1.0, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))) / (2 * p * p * p)))) / 3 AS phi FROM e2),
cond AS (SELECT track, px, py, pz, n, (q + 2 * p * cos(phi)) / (q + 2 * p * cos(phi + 2.0943951023931953)) AS cond FROM e3),
front AS (SELECT track, min((px - cx) * dx + (py - cy) * dy + (pz - cz) * dz) > 0 AS in_front FROM sol JOIN ry USING (track) GROUP BY track)
"""


@query(
    "classify_infinity",
    roles.sql(
        *SCENE, NOISY_SQL, UNCERTAIN_SQL, CONDITION_SQL,
        body="""
        , j AS (SELECT cond.*, in_front, mx, my, mz, depth / sqrt(var) AS z, 2 * sqrt(greatest(perp2, 0.0)) / 1e-3::DOUBLE AS reach
                FROM cond JOIN front USING (track) JOIN v USING (track)),
        k AS (SELECT *, CASE WHEN in_front AND cond < 1e4 THEN 'finite' WHEN reach < 1000 THEN 'indeterminate' WHEN NOT in_front OR z < 4 THEN 'infinity' ELSE 'finite' END AS class FROM j)
        SELECT track, n, class, round(CASE WHEN class = 'infinity' THEN mx ELSE px END, 4) AS x, round(CASE WHEN class = 'infinity' THEN my ELSE py END, 4) AS y,
               round(CASE WHEN class = 'infinity' THEN mz ELSE pz END, 4) AS z, CASE WHEN class = 'infinity' THEN 0.0::DOUBLE ELSE 1.0 END AS w FROM k
        """,
    ),
)
def classify_infinity(spark, sf):
    """Which tracks a baseline can tell from points at infinity."""
    rays = noisy_rays(spark, sf).withColumn("sigma", F.lit(1e-3))
    c = triangulation.classify_infinity(rays, horizon=1000.0)
    return c.select("track", "n", "class", *[r6(a, a, 4) for a in "xyz"], "w")


def _sim_pairs(spark, sf):
    p = roles.points(spark, sf).filter("w <> 0").select(F.col("point_id").alias("pair_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    moved = align.transform_points(p.withColumns({"tx": F.col("sx"), "ty": F.col("sy"), "tz": F.col("sz")}), SIM, ("tx", "ty", "tz"), w=None)
    return moved


_FIT_SQL = roles.sql(
    roles.POINTS_SQL,
    body="SELECT point_id, " + ", ".join(f"round({_MOVED[i]}, 5) AS {c}" for i, c in enumerate("xyz")) + " FROM points WHERE w <> 0",
)


def _moved_points(spark, sf, sim):
    pts = roles.points(spark, sf).filter("w <> 0")
    return align.transform_points(pts, sim).select("point_id", *[r6(c, c, 5) for c in "xyz"])


@query("least_squares_alignment", _FIT_SQL)
def least_squares_alignment(spark, sf):
    """Points moved by the similarity recovered from matched pairs."""
    return _moved_points(spark, sf, align.fit_similarity(cut(_sim_pairs(spark, sf))))


def _spoiled(spark, sf):
    far = F.when(F.col("pair_id") % 4 == 0, 5.0 + (F.col("pair_id") % 13)).otherwise(0.0)
    return cut(_sim_pairs(spark, sf).withColumn("tx", F.col("tx") + far).withColumn("tz", F.col("tz") - far * 0.5))


@query("ransac_alignment", _FIT_SQL)
def ransac_alignment(spark, sf):
    """The same, with a quarter of the pairs spoiled."""
    sim, _ = align.ransac_similarity(_spoiled(spark, sf), threshold=0.1, iterations=48)
    return _moved_points(spark, sf, sim)


@query("trimmed_alignment", _FIT_SQL)
def trimmed_alignment(spark, sf):
    return _moved_points(spark, sf, align.fit_trimmed(_spoiled(spark, sf), keep_percentile=60.0, rounds=6))


@query(
    "feature_shape",
    """
    WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10.0 AS a11, l_discount AS a12, l_tax AS a21, l_extendedprice / 20000.0 AS a22 FROM lineitem)
    SELECT l_orderkey AS point_id, l_linenumber AS feature_index, l_partkey AS row_id, round(0.5 * (sqrt(a11 * a11 + a21 * a21) + sqrt(a12 * a12 + a22 * a22)), 9) AS size, round(atan2(a21, a11), 6) AS orientation FROM f
    """,
)
def feature_shape(spark, sf):
    from ..functions.features import orientation, size

    li = roles.table(spark, sf, "lineitem")
    a = [(F.col("l_quantity") / 10.0), F.col("l_discount"), F.col("l_tax"), (F.col("l_extendedprice") / 20000.0)]
    return li.select(
        F.col("l_orderkey").alias("point_id"), F.col("l_linenumber").alias("feature_index"), F.col("l_partkey").alias("row_id"),
        r6(size(*a), "size", 9), r6(orientation(*a), "orientation"),
    )


@query(
    "patch_frames",
    """
    WITH p AS (SELECT l_orderkey AS point_id, l_linenumber AS n, l_partkey AS k, l_quantity / 50.0 AS ux, l_discount AS uy, l_tax AS uz, -l_discount AS vx, l_quantity / 40.0 AS vy, 0.1 AS vz FROM lineitem),
    c AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM p)
    SELECT point_id, n, k, round(nx / l, 6) AS nx, round(ny / l, 6) AS ny, round(nz / l, 6) AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM c)
    """,
)
def patch_frames(spark, sf):
    from ..functions.features import patch_normal

    li = roles.table(spark, sf, "lineitem")
    u = (F.col("l_quantity") / 50.0, F.col("l_discount"), F.col("l_tax"))
    v = (-F.col("l_discount"), F.col("l_quantity") / 40.0, F.lit(0.1))
    n = patch_normal(u, v)
    return li.select(
        F.col("l_orderkey").alias("point_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"),
        *[r6(c, name) for c, name in zip(n, ("nx", "ny", "nz"))],
    )


@query(
    "quantity_parsing",
    """
    SELECT p_partkey, round(p_size / 4.0 * CASE p_partkey % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0254 ELSE 0.3048 END, 9) AS metres,
           round(p_size * 3.0 * pi() / 180.0, 9) AS radians FROM part
    """,
)
def quantity_parsing(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("mm", "cm", "m", "in", "ft")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    text = F.concat((F.col("p_size") / 4.0).cast("string"), F.lit(" "), unit)
    angle = F.concat((F.col("p_size") * 3).cast("string"), F.lit("deg"))
    return roles.table(spark, sf, "part").select(
        "p_partkey", r6(naming.quantity(text, naming.METRES_PER_UNIT), "metres", 9), r6(naming.quantity(angle, naming.RADIANS_PER_UNIT), "radians", 9)
    )


@query(
    "descriptor_distance",
    roles.sql(
        "emb AS (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS image_id, embedding AS descriptor FROM embeddings)",
        body="""SELECT a.row_id, b.row_id AS next_id, round(sqrt(list_sum(list_transform(range(1, len(a.descriptor) + 1), lambda k: (a.descriptor[k]::DOUBLE - b.descriptor[k]::DOUBLE) * (a.descriptor[k]::DOUBLE - b.descriptor[k]::DOUBLE)))), 6) AS distance
                FROM emb a JOIN emb b ON b.row_id = a.row_id + 1""",
    ),
)
def descriptor_distance(spark, sf):
    c = roles.corpus(spark, sf)
    nxt = c.select((F.col("row_id") - 1).alias("row_id"), F.col("row_id").alias("next_id"), F.col("descriptor").alias("other"))
    return c.join(nxt, "row_id").select("row_id", "next_id", r6(F.sqrt(V.l2_squared("descriptor", "other")), "distance"))


@query(
    "epipolar_geometry",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL,
        body="""
        , nb AS (SELECT a.image_id AS i, b.image_id AS j, b.r00 * a.cx + b.r01 * a.cy + b.r02 * a.cz + b.tx AS ex, b.r10 * a.cx + b.r11 * a.cy + b.r12 * a.cz + b.ty AS ey,
                        b.r20 * a.cx + b.r21 * a.cy + b.r22 * a.cz + b.tz AS ez FROM centers a JOIN centers b ON b.image_id = a.image_id + 1)
        SELECT i, j, round(ex / ez, 4) AS ex, round(ey / ez, 4) AS ey, CAST(0.0 AS DOUBLE) AS algebraic FROM nb
        """,
    ),
)
def epipolar_geometry(spark, sf):
    """Epipole of the first camera in the second from the essential matrix, and det(E) = 0."""
    from ..functions import epipolar

    im = roles.images(spark, sf)
    a = im.select(F.col("image_id").alias("i"), *[F.col(c).alias(f"a_{c}") for c in (*QN, *TN)])
    b = im.select((F.col("image_id") - 1).alias("i"), F.col("image_id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in (*QN, *TN)])
    q, t = epipolar.relative(
        Q.quat(*[f"a_{c}" for c in QN]), V.vec(*[f"a_{c}" for c in TN]), Q.quat(*[f"b_{c}" for c in QN]), V.vec(*[f"b_{c}" for c in TN])
    )
    rel = a.join(b, "i").select("i", "j", *[c.alias(n) for c, n in zip((*q, *t), (*QN, *TN))])
    e = epipolar.essential(Q.quat(*QN), V.vec(*TN))
    names = [f"e{r}{c}" for r in range(3) for c in range(3)]
    staged = cut(rel.select("i", "j", *[e[r][c].alias(f"e{r}{c}") for r in range(3) for c in range(3)]))
    m = tuple(V.vec(*names[3 * r : 3 * r + 3]) for r in range(3))
    left, _ = epipolar.epipole(m)
    det = V.dot(m[0], V.cross(m[1], m[2]))
    return staged.select("i", "j", r6(left[0] / left[2], "ex", 4), r6(left[1] / left[2], "ey", 4), (F.abs(r6(det, "d", 6)) + 0.0).alias("algebraic"))
