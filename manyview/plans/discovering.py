"""Points at infinity found among descriptors that serve as features with directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import infinity, metrics
from . import roles
from .posing import CONDITION_SQL, NOISY_SQL, UNCERTAIN_SQL
from .registry import query, r6

PARAMS = infinity.InfinityParams(eps_deg=20.0, max_distance=1.3, ratio=0.97, min_views=2)
HORIZON = 400.0

TRACKS_SQL = f"""
raw AS (SELECT vec_id AS fid, label::BIGINT + 1 AS image_id, embedding::DOUBLE[] AS e, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS n FROM embeddings),
feats AS (SELECT fid, image_id, e, e[1] / n AS dx, e[2] / n AS dy, e[3] / n AS dz FROM raw),
near AS (SELECT a.fid AS a, b.fid AS b, b.image_id AS image, list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
  FROM feats a JOIN feats b ON a.image_id <> b.image_id AND (a.dx - b.dx) ** 2 + (a.dy - b.dy) ** 2 + (a.dz - b.dz) ** 2 <= 2 * (1 - cos(radians({PARAMS.eps_deg})))),
two AS (SELECT *, row_number() OVER w AS r, lead(d2) OVER w AS second FROM near WINDOW w AS (PARTITION BY a, image ORDER BY d2, b)),
best AS (SELECT a, b, d2 FROM two WHERE r = 1 AND d2 < {PARAMS.max_distance} ** 2 AND (second IS NULL OR d2 < {PARAMS.ratio} ** 2 * second)),
links AS (SELECT x.a, x.b, x.d2 FROM best x JOIN best y ON x.a = y.b AND x.b = y.a),
walk AS (SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.node),
parts AS (SELECT node AS fid, min(root) AS track FROM walk GROUP BY 1),
support AS (SELECT a AS fid, sum(d2) AS support FROM links GROUP BY 1),
chosen AS (SELECT track, image_id, fid FROM parts JOIN support USING (fid) JOIN feats USING (fid) QUALIFY row_number() OVER (PARTITION BY track, image_id ORDER BY support, fid) = 1),
tracks AS (SELECT * FROM chosen QUALIFY count(*) OVER (PARTITION BY track) >= {PARAMS.min_views})
"""


def _features(spark, sf):
    d = [F.col("embedding")[k].cast("double") for k in range(3)]
    raw = roles.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fid"), (F.col("label") + 1).cast("long").alias("image_id"), F.col("embedding").alias("descriptor"),
        *[c.alias(n) for c, n in zip(d, ("ax", "ay", "az"))], V.norm(tuple(d)).alias("n"), F.lit(1e-3).alias("sigma"),
    )
    return raw.select("fid", "image_id", "descriptor", "sigma", *[(F.col(f"a{k}") / F.col("n")).alias(f"d{k}") for k in "xyz"])


@query("infinity_tracks", "WITH RECURSIVE " + TRACKS_SQL.strip() + " SELECT track, image_id, fid FROM tracks")
def infinity_tracks(spark, sf):
    """Features of different images with one direction and alike descriptors, one per image."""
    return infinity.infinity_tracks(_features(spark, sf), PARAMS).select("track", "image_id", "fid")


@query(
    "infinity_points",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, TRACKS_SQL,
        "ry AS (SELECT track, cx, cy, cz, dx, dy, dz FROM tracks JOIN feats USING (fid) JOIN centers ON centers.image_id = tracks.image_id)",
        NOISY_SQL[NOISY_SQL.index("sums AS") :], UNCERTAIN_SQL, CONDITION_SQL,
        body=f"""
        , j AS (SELECT cond.*, in_front, depth / sqrt(var) AS z, 2 * sqrt(greatest(perp2, 0.0)) / 1e-3::DOUBLE AS reach
                FROM cond JOIN front USING (track) JOIN v USING (track))
        SELECT track, n, CASE WHEN in_front AND cond < 1e4 THEN 'finite' WHEN reach < {HORIZON} THEN 'indeterminate' WHEN NOT in_front OR z < 4 THEN 'infinity' ELSE 'finite' END AS class FROM j
        """,
    ),
)
def infinity_points(spark, sf):
    """The found tracks as finite, at infinity or indeterminate."""
    centers = metrics.with_centers(roles.images(spark, sf))
    found = infinity.find_infinity_points(_features(spark, sf), centers, HORIZON, PARAMS)
    return found.select("track", "n", "class")
