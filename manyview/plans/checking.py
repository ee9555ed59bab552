"""Integrity and workspace queries on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Recon
from ..operators import integrity
from . import roles
from .registry import query


@query(
    "verify_reconstruction",
    """
    WITH o AS (SELECT l_orderkey AS p, l_suppkey AS i FROM lineitem)
    SELECT 'obs_without_point' AS check_name, count(*) AS violations FROM o WHERE p NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'obs_without_image', count(*) FROM o WHERE i NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'point_without_obs', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT p FROM o)
    UNION ALL SELECT 'duplicate_point', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_image_name', count(*) FROM (SELECT s_name FROM supplier GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'repeated_image_in_track', count(*) FROM (SELECT p, i FROM o GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'infinity_not_unit', 0
    UNION ALL SELECT 'observation_count_mismatch', count(*) FROM (SELECT p FROM o GROUP BY 1 HAVING count(*) <> count(DISTINCT i))
    """,
)
def verify_reconstruction(spark, sf):
    li = roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id"))
    stored = li.groupBy("point_id").agg(F.countDistinct("image_id").alias("n"))
    return integrity.verify_reconstruction(Recon(roles.images(spark, sf), roles.points(spark, sf), li), stored)


@query(
    "verify_matches",
    """
    WITH p AS (SELECT l_suppkey AS i, l_partkey % 100 AS j, l_linenumber AS a, l_orderkey AS b FROM lineitem)
    SELECT 'pair_not_ordered' AS check_name, count(*) AS violations FROM p WHERE i >= j
    UNION ALL SELECT 'repeated_match', count(*) FROM (SELECT 1 FROM p GROUP BY i, j, a, b HAVING count(*) > 1)
    UNION ALL SELECT 'left_feature_reused', count(*) FROM (SELECT 1 FROM (SELECT DISTINCT * FROM p) GROUP BY i, j, a HAVING count(*) > 1)
    UNION ALL SELECT 'two_features_in_image', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)
    UNION ALL SELECT 'single_member_cluster', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) < 2)
    """,
)
def verify_matches(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    p = li.select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 100).alias("j"), F.col("l_linenumber").alias("feature_i"), F.col("l_orderkey").alias("feature_j"))
    m = li.select(F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("image_id"))
    return integrity.verify_matches(p, m)


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf):
    """The hash of every document's bytes."""
    d = roles.table(spark, sf, "documents")
    return d.select("doc_id", integrity.content_hash(F.col("text")).alias("content_hash"))


@query(
    "stale_hashes",
    """
    SELECT d.doc_id AS name, CASE WHEN l.quality = 1 THEN sha256(d.text) WHEN l.quality = 0 THEN md5(d.text) END AS stored, sha256(d.text) AS computed
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.quality <> 1
    """,
)
def stale_hashes(spark, sf):
    """Documents without a stored hash, or with one that isn't their content's."""
    d = roles.table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("content"))
    kept = d.join(roles.table(spark, sf, "labels").withColumnRenamed("doc_id", "name"), "name")
    stored = kept.select("name", F.when(F.col("quality") == 1, integrity.content_hash(F.col("content"))).otherwise(F.md5("content")).alias("stored"))
    return integrity.stale_hashes(d, stored)


@query(
    "find_by_hash_prefix",
    "SELECT doc_id, md5(text) AS content_hash FROM documents WHERE starts_with(md5(text), 'a')",
)
def find_by_hash_prefix(spark, sf):
    h = roles.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return h.filter(F.startswith("content_hash", F.lit("a")))


@query(
    "stale_features",
    """
    SELECT d.doc_id, md5(d.text) AS content_hash FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents e ON e.doc_id = l.doc_id WHERE l.quality = 1 AND md5(e.text) = md5(d.text))
    """,
)
def stale_features(spark, sf):
    """Images whose content has no extracted features yet."""
    from ..streaming.ingest import pending

    d = roles.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    done = d.join(roles.table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi").withColumn("tool_hash", F.lit("t1"))
    return pending(d.withColumn("tool_hash", F.lit("t1")), done).select("doc_id", "content_hash")


@query(
    "ply_vertices",
    roles.sql(
        roles.POINTS_SQL,
        body="SELECT point_id, printf('%.6f %.6f %.6f %d %d %d', x, y, z, point_id % 256, point_id * 3 % 256, point_id * 5 % 256) AS line FROM points WHERE w <> 0",
    ),
)
def ply_vertices(spark, sf):
    from ..sources.export import ply_vertices as lines

    k = F.col("point_id")
    return lines(roles.points(spark, sf).withColumns({"r": k % 256, "g": k * 3 % 256, "b": k * 5 % 256}))


@query(
    "frame_transforms",
    roles.sql(
        roles.IMAGES_SQL,
        body="""
        , r AS (SELECT *, 1 - 2 * (qy * qy + qz * qz) AS a, 2 * (qx * qy - qw * qz) AS b, 2 * (qx * qz + qw * qy) AS c,
                          2 * (qx * qy + qw * qz) AS d, 1 - 2 * (qx * qx + qz * qz) AS e, 2 * (qy * qz - qw * qx) AS f,
                          2 * (qx * qz - qw * qy) AS g, 2 * (qy * qz + qw * qx) AS h, 1 - 2 * (qx * qx + qy * qy) AS i FROM images)
        SELECT image_id, name AS file_path, round(a, 6) AS m00, round(d, 6) AS m01, round(g, 6) AS m02, round(-(a * tx + d * ty + g * tz), 6) AS m03,
               round(b, 6) AS m10, round(e, 6) AS m11, round(h, 6) AS m12, round(-(b * tx + e * ty + h * tz), 6) AS m13,
               round(c, 6) AS m20, round(f, 6) AS m21, round(i, 6) AS m22, round(-(c * tx + f * ty + i * tz), 6) AS m23 FROM r
        """,
    ),
)
def frame_transforms(spark, sf):
    """The exported camera-to-world matrices, read back from their JSON."""
    from ..sources.export import frame_transforms as frames

    out = frames(roles.images(spark, sf), roles.harness_cameras(roles.table(spark, sf, "nation")))
    row = F.from_json("json", "file_path string, transform_matrix array<array<double>>")
    cell = [F.round(row["transform_matrix"][k][j], 6).alias(f"m{k}{j}") for k in range(3) for j in range(4)]
    return out.select("image_id", row["file_path"].alias("file_path"), *cell)


@query(
    "transform_steps",
    roles.sql(
        roles.POINTS_SQL, roles.OBS_SQL,
        body="""
        , im AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS k FROM (SELECT s_suppkey AS image_id, CAST(regexp_extract(s_name, '(\\d+)$', 1) AS BIGINT) AS num FROM supplier)
                 WHERE num BETWEEN 0 AND 60 OR num BETWEEN 80 AND 99),
        e AS (SELECT point_id, x, y, z, w FROM points WHERE error <= 1.5),
        o1 AS (SELECT o.point_id, k FROM obs o JOIN e USING (point_id) JOIN im USING (image_id)),
        keep AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS new_id FROM (SELECT DISTINCT point_id FROM o1)),
        n AS (SELECT new_id, count(*) AS n FROM o1 JOIN keep USING (point_id) GROUP BY 1 HAVING count(*) > 2)
        SELECT new_id AS point_id, n AS n_obs, round(CASE WHEN w = 0 THEN x ELSE 2 * x END, 6) AS x, round(CASE WHEN w = 0 THEN z ELSE 2 * z END, 6) AS z
        FROM n JOIN keep USING (new_id) JOIN e USING (point_id)
        """,
    ),
)
def transform_steps(spark, sf):
    """Several steps in a row on one reconstruction."""
    from . import transforms as S

    out = roles.recon(spark, sf).transform(
        S.filter_by_reprojection_error(1.5), S.include_range("0-60,80-99"), S.remove_short_tracks(2), S.scale(2.0)
    )
    n = out.obs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return out.points.join(n, "point_id").select("point_id", "n_obs", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))
