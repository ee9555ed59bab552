"""Two-view and infinity queries on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convention, epipolar
from ..functions import quat as Q
from ..functions import vec as V
from ..operators import metrics, robust, twoview
from ..session import cut
from . import roles
from .geometric import steps
from .posing import QN, TN
from .registry import query, r6

# Every image pair gets its own planar map; the oracle states where the image centre goes.
_MAP = {
    "u": "(1.02 * x + 0.03 * y + pair) / (0.0001 * x - 0.00005 * y + 1.0)",
    "v": "(-0.02 * x + 0.97 * y + 2 * pair) / (0.0001 * x - 0.00005 * y + 1.0)",
}


@query(
    "pair_homography",
    f"""
    WITH m AS (SELECT l_suppkey AS pair, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 4),
    c AS (SELECT pair, n, 500.0 AS x, 400.0 AS y FROM m)
    SELECT pair, n, round({_MAP['u']}, 3)::DOUBLE AS u, round({_MAP['v']}, 3)::DOUBLE AS v FROM c
    """,
)
def pair_homography(spark, sf):
    """Where the fitted homography of each pair sends the image centre."""
    li = roles.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pair"), (F.col("l_quantity") * 20.0).alias("x"), (F.col("l_extendedprice") / 125.0).alias("y")
    )
    m = li.select("pair", "x", "y", *[F.expr(e).cast("double").alias(c) for c, e in _MAP.items()])
    fit = twoview.fit_homography(m)
    h = [F.element_at("h", k) for k in range(1, 10)]
    w = h[6] * 500.0 + h[7] * 400.0 + h[8]
    return fit.select("pair", "n", r6((h[0] * 500.0 + h[1] * 400.0 + h[2]) / w, "u", 3), r6((h[3] * 500.0 + h[4] * 400.0 + h[5]) / w, "v", 3))


@query(
    "essential_from_rays",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL,
        body="""
        , nb AS (SELECT a.image_id AS pair, b.r00 * a.cx + b.r01 * a.cy + b.r02 * a.cz + b.tx AS ex, b.r10 * a.cx + b.r11 * a.cy + b.r12 * a.cz + b.ty AS ey,
                        b.r20 * a.cx + b.r21 * a.cy + b.r22 * a.cz + b.tz AS ez FROM centers a JOIN centers b ON b.image_id = a.image_id + 1),
        c AS (SELECT image_id AS pair, count(*) AS n FROM obs JOIN points p USING (point_id) WHERE p.w <> 0 GROUP BY 1)
        SELECT pair, n, round(ex / ez, 3) AS ex, round(ey / ez, 3) AS ey FROM nb JOIN c USING (pair) WHERE n >= 8
        """,
    ),
)
def essential_from_rays(spark, sf):
    """Epipole of each image in its successor, from bearings alone."""
    im = roles.images(spark, sf)
    o = roles.track_pairs(spark, sf)
    p = roles.points(spark, sf).filter("w <> 0").select("point_id", "x", "y", "z")
    a = im.select("image_id", *[F.col(c).alias(f"a_{c}") for c in (*QN, *TN)])
    b = im.select((F.col("image_id") - 1).alias("image_id"), *[F.col(c).alias(f"b_{c}") for c in (*QN, *TN)])
    j = o.join(p, "point_id").join(a.join(b, "image_id"), "image_id")
    x = V.vec("x", "y", "z")
    ca = Q.to_camera(Q.quat(*[f"a_{c}" for c in QN]), V.vec(*[f"a_{c}" for c in TN]), x)
    cb = Q.to_camera(Q.quat(*[f"b_{c}" for c in QN]), V.vec(*[f"b_{c}" for c in TN]), x)
    j = j.select(F.col("image_id").alias("pair"), *[c.alias(n) for c, n in zip((*ca, *cb), ("pa", "pb", "pc", "qa", "qb", "qc"))])
    j = j.withColumns({"na": V.norm(V.vec("pa", "pb", "pc")), "nb": V.norm(V.vec("qa", "qb", "qc"))})
    rays = j.select("pair", *[(F.col(f"p{k}") / F.col("na")).alias(f"a{c}") for k, c in zip("abc", "xyz")], *[(F.col(f"q{k}") / F.col("nb")).alias(f"b{c}") for k, c in zip("abc", "xyz")])
    fit = cut(twoview.fit_essential(rays))
    m = tuple(tuple(F.element_at("e", 3 * r + c + 1) for c in range(3)) for r in range(3))
    left, _ = epipolar.epipole(m)
    return fit.select("pair", "n", r6(left[0] / left[2], "ex", 3), r6(left[1] / left[2], "ey", 3))


@query(
    "pair_homography_robust",
    f"""
    WITH li AS (SELECT DISTINCT l_suppkey AS pair, l_quantity * 20.0 AS x, l_extendedprice / 125.0 AS y FROM lineitem),
    n AS (SELECT pair, count(*) AS n, count(*) FILTER (WHERE round(x + y * 125.0) % 3 <> 0) AS inliers FROM li GROUP BY 1),
    c AS (SELECT pair, n, inliers, 500.0 AS x, 400.0 AS y FROM n WHERE inliers >= 12)
    SELECT pair, n, inliers, round({_MAP['u']}, 3)::DOUBLE AS u, round({_MAP['v']}, 3)::DOUBLE AS v FROM c
    """,
)
def pair_homography_robust(spark, sf):
    """Where each pair's homography sends the image centre, with a third of the matches far off."""
    li = roles.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pair"), (F.col("l_quantity") * 20.0).alias("x"), (F.col("l_extendedprice") / 125.0).alias("y")
    ).distinct()
    m = li.select("pair", "x", "y", *[F.expr(e).cast("double").alias(c) for c, e in _MAP.items()])
    spoiled = F.round(F.col("x") + F.col("y") * 125.0) % 3 == 0
    far = 40.0 + F.pmod(F.xxhash64("x", "y"), F.lit(400))
    m = m.withColumns({"u": F.when(spoiled, F.col("u") + far).otherwise(F.col("u")), "v": F.when(spoiled, F.col("v") - far).otherwise(F.col("v"))})
    fit = robust.estimate(m, robust.HOMOGRAPHY)
    h = [F.element_at("model", k) for k in range(1, 10)]
    w = h[6] * 500.0 + h[7] * 400.0 + h[8]
    return fit.select("pair", "n", "inliers", r6((h[0] * 500.0 + h[1] * 400.0 + h[2]) / w, "u", 3), r6((h[3] * 500.0 + h[4] * 400.0 + h[5]) / w, "v", 3))


_E = [f"e{r}{c}" for r in range(3) for c in range(3)]
#: Points seen by an image, and their places in the frames of the image and of the next, z forward.
_SEEN_SQL = """
cam AS (SELECT image_id, 500.0 + 10 * camera_id AS f, [[r00, r01, r02], [-r10, -r11, -r12], [-r20, -r21, -r22]] AS r, [tx, -ty, -tz] AS t FROM poses),
""" + steps(
    "rel",
    "SELECT a.image_id AS pair, a.r AS ra, a.t AS ta, b.r AS rb, b.t AS tb FROM cam a JOIN cam b ON b.image_id = a.image_id + 1",
    "[[list_dot_product(x, y) FOR y IN ra] FOR x IN rb] AS m",
    "[tb[k] - list_dot_product(m[k], ta) FOR k IN [1, 2, 3]] AS tr",
    """[[tr[2] * m[3][k] - tr[3] * m[2][k] FOR k IN [1, 2, 3]], [tr[3] * m[1][k] - tr[1] * m[3][k] FOR k IN [1, 2, 3]], [tr[1] * m[2][k] - tr[2] * m[1][k] FOR k IN [1, 2, 3]]] AS e0""",
    "sqrt(list_sum([list_dot_product(x, x) FOR x IN e0])) * CASE WHEN list_max(flatten(e0)) >= -list_min(flatten(e0)) THEN 1.0 ELSE -1.0 END AS size",
    "[[v / size FOR v IN x] FOR x IN e0] AS e",
) + """,
seen AS (SELECT DISTINCT pair, point_id,
  list_dot_product(ra[3], [x, y, z]) + ta[3] AS da, list_dot_product(rb[3], [x, y, z]) + tb[3] AS db FROM (SELECT image_id AS pair, point_id FROM obs) JOIN points USING (point_id) JOIN rel USING (pair) WHERE w <> 0),
few AS (SELECT pair, count(*) AS n, count(*) FILTER (WHERE point_id % 4 <> 0) AS inliers FROM seen WHERE da > 2.0 AND db > 2.0 GROUP BY 1)
"""


@query(
    "pair_fundamental",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL, _SEEN_SQL,
        body="SELECT pair, n, inliers, " + ", ".join(f"round(e[{r + 1}][{c + 1}], 4) + 0.0 AS e{r}{c}" for r in range(3) for c in range(3)) + " FROM few JOIN rel USING (pair) WHERE n >= 40",
    ),
)
def pair_fundamental(spark, sf):
    """Each pair's fundamental matrix, seen through its cameras, from matches of which a quarter lies far from its line."""
    fit = robust.estimate(_spoiled_matches(spark, sf).select("pair", "x", "y", "u", "v"), robust.FUNDAMENTAL)
    f = roles.images(spark, sf).select(F.col("image_id").alias("pair"), (500.0 + 10 * F.col("camera_id")).alias("f"))
    j = fit.join(f.withColumnRenamed("f", "fa"), "pair").join(f.select((F.col("pair") - 1).alias("pair"), F.col("f").alias("fb")), "pair")
    m = [[F.element_at("model", 3 * r + c + 1) for c in range(3)] for r in range(3)]
    k = lambda n: ((F.col(n), F.lit(0.0), F.lit(500.0)), (F.lit(0.0), F.col(n), F.lit(400.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    ka, kb = k("fa"), k("fb")
    half = [[sum((m[r][i] * ka[i][c] for i in range(1, 3)), m[r][0] * ka[0][c]) for c in range(3)] for r in range(3)]
    e = [sum((kb[i][r] * half[i][c] for i in range(1, 3)), kb[0][r] * half[0][c]) for r in range(3) for c in range(3)]
    seen = j.select("pair", "n", "inliers", F.array(*e).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    sign = F.when(F.array_max("e") >= -F.array_min("e"), 1.0).otherwise(-1.0)
    return seen.select("pair", "n", "inliers", *[(F.round(F.element_at("e", i + 1) * sign / size, 4) + 0.0).alias(n) for i, n in enumerate(_E)])


def _spoiled_matches(spark, sf):
    """Pixels of points in an image and the next, as far as both look at them; every fourth point's
    second pixel is moved across its epipolar line."""
    im = roles.images(spark, sf)
    side = lambda t, back: im.select((F.col("image_id") - back).alias("pair"), (500.0 + 10 * F.col("camera_id")).alias(f"{t}_f"), *[F.col(c).alias(f"{t}_{c}") for c in (*QN, *TN)])
    j = roles.track_pairs(spark, sf).withColumnRenamed("image_id", "pair").join(roles.points(spark, sf).filter("w <> 0"), "point_id")
    j = j.join(side("a", 0), "pair").join(side("b", 1), "pair")
    for t, (px, py) in (("a", ("x0", "y0")), ("b", ("u0", "v0"))):
        p = Q.to_camera(Q.quat(*[f"{t}_{c}" for c in QN]), V.vec(*[f"{t}_{c}" for c in TN]), V.vec("x", "y", "z"))
        j = j.select("*", *[c.alias(f"{t}_p{n}") for c, n in zip(p, "xyz")])
        depth = -F.col(f"{t}_pz")
        j = j.filter(depth > 2.0).withColumns({px: F.col(f"{t}_f") * F.col(f"{t}_px") / depth + 500.0, py: F.col(f"{t}_f") * -F.col(f"{t}_py") / depth + 400.0})
    poses = [_optical(t) for t in "ab"]
    f = epipolar.inverse_intrinsics(
        epipolar.essential(*epipolar.relative(*poses[0], *poses[1])),
        *({"fx": F.col(f"{t}_f"), "fy": F.col(f"{t}_f"), "cx": F.lit(500.0), "cy": F.lit(400.0)} for t in "ab"),
    )
    line = [f[r][0] * F.col("x0") + f[r][1] * F.col("y0") + f[r][2] for r in range(2)]
    j = j.select("pair", "point_id", "x0", "y0", "u0", "v0", line[0].alias("lx"), line[1].alias("ly"))
    away = F.when(F.col("point_id") % 4 == 0, 2000.0 + F.col("point_id") % 1000).otherwise(0.0) / F.sqrt(F.col("lx") ** 2 + F.col("ly") ** 2)
    j = j.select("pair", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("u0") + away * F.col("lx")).alias("u"), (F.col("v0") + away * F.col("ly")).alias("v"))
    j = cut(j)
    return j.join(j.groupBy("pair").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 40"), "pair")


def _optical(t: str):
    """The pose of one side with z forward."""
    return convention.flip_camera(Q.quat(*[f"{t}_{c}" for c in QN]), V.vec(*[f"{t}_{c}" for c in TN]))


@query(
    "camera_spread",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, roles.OBS_SQL,
        body="""SELECT point_id, count(*) AS n, round(sqrt((max(cx) - min(cx)) * (max(cx) - min(cx)) + (max(cy) - min(cy)) * (max(cy) - min(cy)) + (max(cz) - min(cz)) * (max(cz) - min(cz))), 6) AS spread
                FROM obs JOIN centers USING (image_id) GROUP BY 1""",
    ),
)
def camera_spread(spark, sf):
    """Extent of the cameras observing each point: the baseline that decides whether depth is knowable."""
    c = metrics.with_centers(roles.images(spark, sf)).select("image_id", "cx", "cy", "cz")
    j = roles.track_pairs(spark, sf).join(c, "image_id")
    side = {k: F.max(k) - F.min(k) for k in ("cx", "cy", "cz")}
    return j.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(sum((e * e for e in list(side.values())[1:]), side["cx"] * side["cx"])), "spread"))
