"""Filters and selections on the harness tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import naming
from ..functions import quat as Q
from ..functions import vec as V
from ..operators import filters, metrics
from . import roles
from .registry import query, r6


@query(
    "point_mask_renumber",
    roles.sql(
        roles.POINTS_SQL, roles.OBS_SQL,
        body="""
        , kept AS (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS new_id FROM points WHERE error <= 1.0)
        SELECT k.new_id AS point_id, k.point_id AS old_point_id, round(k.x, 6) AS x, round(k.error, 6) AS error,
               coalesce(n, 0) AS n_obs
        FROM kept k LEFT JOIN (SELECT point_id, count(*) AS n FROM obs GROUP BY 1) o USING (point_id)
        """,
    ),
)
def point_mask_renumber(spark, sf):
    recon = roles.recon(spark, sf)
    kept = filters.by_reprojection_error(recon.points, 1.0)
    out = filters.keep_points(recon, kept, renumber=True)
    n = out.obs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))
    return out.points.join(n, "point_id", "left").select(
        "point_id", "old_point_id", r6("x", "x"), r6("error", "error"), F.coalesce("n", F.lit(0)).alias("n_obs")
    )


@query(
    "image_subset",
    roles.sql(
        roles.OBS_SQL,
        body="""
        , chosen AS (SELECT s_suppkey AS image_id, row_number() OVER (ORDER BY -s_acctbal, s_suppkey) - 1 AS new_image
                     FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
                     WHERE r_name = 'ASIA'),
        o AS (SELECT point_id, new_image, feature_index FROM obs JOIN chosen USING (image_id)),
        p AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS new_point
              FROM (SELECT DISTINCT point_id FROM o JOIN orders ON o_orderkey = point_id))
        SELECT new_point AS point_id, new_image AS image_id, feature_index FROM o JOIN p USING (point_id)
        """,
    ),
)
def image_subset(spark, sf):
    recon = roles.recon(spark, sf)
    t = lambda n: roles.table(spark, sf, n)
    chosen = (
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("image_id"), (-F.col("s_acctbal")).alias("ord"))
    )
    out = filters.subset_images(recon, chosen)
    return out.obs.select("point_id", "image_id", "feature_index")


@query(
    "short_track_filter",
    "SELECT l_orderkey AS point_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 2",
)
def short_track_filter(spark, sf):
    return filters.longer_tracks(roles.track_pairs(spark, sf), 2)


RAYS_SQL = """
finite_rays AS (
  SELECT o.point_id, o.image_id, (p.x / p.w - c.cx) AS rx, (p.y / p.w - c.cy) AS ry, (p.z / p.w - c.cz) AS rz, c.cx, c.cy, c.cz
  FROM obs o JOIN points p USING (point_id) JOIN centers c USING (image_id) WHERE p.w <> 0),
rays AS (
  SELECT point_id, image_id, rx / n AS dx, ry / n AS dy, rz / n AS dz, cx, cy, cz
  FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS n FROM finite_rays) WHERE n > 1e-12)
"""

ANGLES_SQL = """
angles AS (
  SELECT a.point_id, acos(least(1.0, greatest(-1.0, min(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz)))) AS max_angle
  FROM rays a JOIN rays b ON a.point_id = b.point_id AND a.image_id < b.image_id GROUP BY 1)
"""

SCENE = (roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL)


def scene_rays(spark, sf):
    recon = roles.recon(spark, sf)
    return filters.rays(recon.obs, recon.points, metrics.with_centers(recon.images))


@query(
    "max_viewing_angle",
    roles.sql(*SCENE, RAYS_SQL, ANGLES_SQL, body="SELECT point_id, round(max_angle, 6) AS max_angle FROM angles"),
)
def max_viewing_angle(spark, sf):
    return filters.max_viewing_angles(scene_rays(spark, sf)).select("point_id", r6("max_angle", "max_angle"))


@query(
    "narrow_track_filter",
    roles.sql(
        *SCENE, RAYS_SQL, ANGLES_SQL,
        body="""SELECT point_id FROM points LEFT JOIN angles USING (point_id)
                WHERE w = 0 OR max_angle >= 1.0471975511965976""",
    ),
)
def narrow_track_filter(spark, sf):
    angles = filters.max_viewing_angles(scene_rays(spark, sf))
    return filters.wide_tracks(roles.points(spark, sf), angles, math.pi / 3)


@query(
    "isolated_point_filter",
    roles.sql(
        roles.POINTS_SQL,
        body="""
        , f AS (SELECT point_id, x / w AS x, y / w AS y, z / w AS z FROM points WHERE w <> 0),
        nn AS (SELECT a.point_id, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d
               FROM f a JOIN f b ON a.point_id <> b.point_id GROUP BY 1),
        lim AS (SELECT 1.5 * quantile_cont(d, 0.9) AS m FROM nn)
        SELECT point_id FROM nn, lim WHERE d <= m UNION ALL SELECT point_id FROM points WHERE w = 0
        """,
    ),
)
def isolated_point_filter(spark, sf):
    return filters.not_isolated(roles.points(spark, sf), 1.5, 90.0)


@query(
    "large_feature_filter",
    roles.sql(
        roles.OBS_SQL,
        body="""SELECT point_id, CAST(max(p_size + image_id % 9) AS BIGINT) AS max_size FROM obs JOIN part ON p_partkey = feature_index
                GROUP BY 1 HAVING max(p_size + image_id % 9) <= 36""",
    ),
)
def large_feature_filter(spark, sf):
    seen = roles.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("feature_index")).distinct()
    part = roles.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_index"), "p_size")
    sizes = seen.join(part, "feature_index").withColumn("size", (F.col("p_size") + F.col("image_id") % 9).cast("long"))
    return filters.small_features(roles.obs(spark, sf), sizes, 36)


@query(
    "reprojection_error_filter",
    roles.sql(roles.POINTS_SQL, body="SELECT point_id, round(error, 6) AS error FROM points WHERE error <= 0.75"),
)
def reprojection_error_filter(spark, sf):
    return filters.by_reprojection_error(roles.points(spark, sf), 0.75).select("point_id", r6("error", "error"))


@query(
    "patch_size_filter",
    """
    WITH s AS (SELECT p_partkey, sqrt(p_size * (p_retailprice / 100.0)) AS e FROM part),
    m AS (SELECT 1.2 * median(e) AS lim FROM s)
    SELECT p_partkey, round(e, 6) AS extent FROM s, m WHERE e <= lim
    """,
)
def patch_size_filter(spark, sf):
    p = roles.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("hu"), (F.col("p_retailprice") / 100.0).alias("hv"))
    return filters.by_patch_size(p, "p_partkey", "hu", "hv", 1.2).select("p_partkey", r6("extent", "extent"))


@query(
    "localizability_filter",
    """SELECT l_orderkey AS point_id, round(max(l_discount / nullif(l_tax, 0)), 6) AS sigma FROM lineitem GROUP BY 1
       HAVING max(l_discount / nullif(l_tax, 0)) IS NULL OR max(l_discount / nullif(l_tax, 0)) <= 2.5""",
)
def localizability_filter(spark, sf):
    s = F.max(F.col("l_discount") / F.nullif("l_tax", F.lit(0.0)))
    scores = roles.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("point_id")).agg(s.alias("sigma"))
    return filters.by_localizability(scores, "sigma", 2.5).select("point_id", r6("sigma", "sigma"))


NUMBER_SQL = "CAST(nullif(regexp_extract(name, '(\\d+)$', 1), '') AS BIGINT)"


def _customers(spark, sf):
    return roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"))


@query(
    "image_range_include",
    f"""WITH c AS (SELECT c_custkey AS image_id, c_name AS name FROM customer), n AS (SELECT *, {NUMBER_SQL} AS k FROM c)
        SELECT image_id, name FROM n WHERE k BETWEEN 10 AND 500 OR k = 700 OR (k BETWEEN 800 AND 90000 AND (k - 800) % 3 = 0)""",
)
def image_range_include(spark, sf):
    return filters.images_in_range(_customers(spark, sf), "10-500,700,800-90000:3")


@query(
    "image_range_exclude",
    f"""WITH c AS (SELECT page_id AS image_id, url AS name FROM pages),
        n AS (SELECT *, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(name, '^.*[/\\\\]', ''), '(.)\\.[^.]*$', '\\1'), '(\\d+)$', 1), ''), 'none') AS k FROM c)
        SELECT image_id, name FROM n WHERE NOT (k <> 'none' AND TRY_CAST(k AS BIGINT) BETWEEN 100 AND 600)""",
)
def image_range_exclude(spark, sf):
    pages = roles.table(spark, sf, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("name"))
    return filters.images_in_range(pages, "100-600", include=False)


@query("image_glob_include", "SELECT page_id AS image_id, url AS name FROM pages WHERE url GLOB '*example.net/[a-e]?/*.html'")
def image_glob_include(spark, sf):
    pages = roles.table(spark, sf, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("name"))
    return filters.images_matching(pages, "*example.net/[a-e]?/*.html")


@query("image_glob_exclude", "SELECT page_id AS image_id, url AS name FROM pages WHERE NOT url GLOB '*.html'")
def image_glob_exclude(spark, sf):
    pages = roles.table(spark, sf, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("name"))
    return filters.images_matching(pages, "*.html", include=False)


@query(
    "file_numbers",
    """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '(.)\\.[^.]*$', '\\1') AS stem FROM pages)
       SELECT page_id, CAST(coalesce(nullif(regexp_extract(stem, '\\((\\d+)\\)$', 1), ''), nullif(regexp_extract(stem, '(\\d+)$', 1), '')) AS BIGINT) AS number FROM s""",
)
def file_numbers(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", naming.file_number("url").alias("number"))


MEMBERS_SQL = """
members AS (
  SELECT l_orderkey AS cluster_id, l_suppkey AS image_id, l_partkey AS feature_index, l_returnflag AS status,
         CASE WHEN l_tax = 0 THEN CAST('nan' AS DOUBLE) ELSE l_discount END AS consistency
  FROM lineitem)
"""


def members(spark, sf):
    return roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("feature_index"),
        F.col("l_returnflag").alias("status"),
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_discount")).alias("consistency"),
    )


@query(
    "cluster_selection",
    roles.sql(
        MEMBERS_SQL,
        body="""
        , k AS (SELECT * FROM members WHERE status IN ('A', 'R') AND image_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)),
        ids AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS new_cluster_id
                FROM (SELECT cluster_id FROM k GROUP BY 1 HAVING count(DISTINCT image_id) >= 2))
        SELECT new_cluster_id, cluster_id, image_id, feature_index FROM k JOIN ids USING (cluster_id)
        """,
    ),
)
def cluster_selection(spark, sf):
    imgs = roles.table(spark, sf, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("image_id"))
    out = filters.select_clusters(members(spark, sf), imgs, ("A", "R"), 2)
    return out.select("new_cluster_id", "cluster_id", "image_id", "feature_index")


@query(
    "cluster_worst_consistency",
    roles.sql(
        MEMBERS_SQL,
        body="""SELECT cluster_id, coalesce(max(CASE WHEN isfinite(consistency) THEN consistency END), CAST('inf' AS DOUBLE)) AS worst_consistency
                FROM members GROUP BY 1""",
    ),
)
def cluster_worst_consistency(spark, sf):
    return filters.worst_consistency(members(spark, sf))


SHARED_SQL = """
tracks AS (SELECT DISTINCT l_orderkey AS point_id, l_suppkey AS image_id FROM lineitem),
shared AS (SELECT a.image_id AS i, b.image_id AS j, count(*) AS shared
           FROM tracks a JOIN tracks b ON a.point_id = b.point_id AND a.image_id < b.image_id GROUP BY 1, 2)
"""


@query(
    "pair_pruning",
    roles.sql(
        SHARED_SQL,
        body="""
        , p AS (SELECT *, abs(j - i) AS gap FROM shared),
        far AS (SELECT * FROM (SELECT * FROM p WHERE gap > 4 ORDER BY gap, i, j LIMIT 900) ORDER BY shared DESC, gap, i, j LIMIT 300)
        SELECT i, j, shared, 'close' AS kind FROM p WHERE gap <= 4 UNION ALL SELECT i, j, shared, 'distant' FROM far
        """,
    ),
)
def pair_pruning(spark, sf):
    from ..operators.pairs import shared_counts

    pairs = shared_counts(roles.sightings(spark, sf), "point_id").withColumn("score", F.col("shared"))
    return filters.prune_image_pairs(pairs, close=4, max_distant=300, search=3).select("i", "j", "shared", "kind")


FRUSTUM_SQL = """
in_view AS (
  SELECT image_id, point_id FROM (
    SELECT o.image_id, o.point_id, r00 * p.x + r01 * p.y + r02 * p.z + tx AS x, r10 * p.x + r11 * p.y + r12 * p.z + ty AS y,
           -(r20 * p.x + r21 * p.y + r22 * p.z + tz) AS d
    FROM obs o JOIN points p USING (point_id) JOIN poses USING (image_id) WHERE p.w <> 0)
  WHERE d >= 0.5 AND d <= 12 AND 600 * x >= -500 * d AND 600 * x <= 500 * d AND -(600 * y) >= -400 * d AND -(600 * y) <= 400 * d)
"""


@query(
    "points_in_frustum",
    roles.sql(*SCENE, FRUSTUM_SQL, body="SELECT image_id, count(*) AS n FROM in_view GROUP BY 1"),
)
def points_in_frustum(spark, sf):
    recon = roles.recon(spark, sf)
    j = (
        recon.obs.select("point_id", "image_id")
        .join(recon.points.filter("w <> 0").select("point_id", "x", "y", "z"), "point_id")
        .join(recon.images, "image_id")
    )
    inside = filters.in_frustum(
        Q.quat("qw", "qx", "qy", "qz"), V.vec("tx", "ty", "tz"), V.vec("x", "y", "z"), 600.0, 600.0, 500.0, 400.0, 1000.0, 800.0, 0.5, 12.0
    )
    return j.filter(inside).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "near_source_images",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL,
        body="""
        , ref AS (SELECT cx AS rx, cy AS ry, cz AS rz FROM centers WHERE name = 'Supplier#000000003')
        SELECT image_id, round(sqrt((cx - rx) * (cx - rx) + (cy - ry) * (cy - ry) + (cz - rz) * (cz - rz)), 6) AS dist
        FROM centers, ref WHERE sqrt((cx - rx) * (cx - rx) + (cy - ry) * (cy - ry) + (cz - rz) * (cz - rz)) <= 8.0
        """,
    ),
)
def near_source_images(spark, sf):
    c = metrics.with_centers(roles.images(spark, sf))
    return filters.near_images(c, "Supplier#000000003", radius=8.0).select("image_id", r6("dist", "dist"))


@query(
    "grazing_observations",
    roles.sql(
        *SCENE, RAYS_SQL,
        body="""
        , m AS (SELECT point_id, -sum(dx) AS sx, -sum(dy) AS sy, -sum(dz) AS sz FROM rays GROUP BY 1),
        n AS (SELECT point_id, sx / l AS nx, sy / l AS ny, sz / l AS nz FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM m) WHERE l > 0)
        SELECT point_id, count(*) AS kept FROM rays JOIN n USING (point_id)
        WHERE abs(dx * nx + dy * ny + dz * nz) >= cos(radians(60.0)) GROUP BY 1
        """,
    ),
)
def grazing_observations(spark, sf):
    rays = scene_rays(spark, sf)
    normals = metrics.viewing_normals(rays)
    kept = filters.drop_grazing(rays.join(normals, "point_id"), 60.0)
    return kept.groupBy("point_id").agg(F.count(F.lit(1)).alias("kept"))
