"""Correspondences and match-table operators on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import merge, pairs
from . import roles
from .registry import query, r6

SIDES_SQL = """
src AS (SELECT l_orderkey AS point_id, l_suppkey AS image_id, l_partkey AS feature_index FROM lineitem WHERE l_returnflag = 'A'),
tgt AS (SELECT l_orderkey AS point_id, l_suppkey AS image_id, l_partkey AS feature_index FROM lineitem WHERE l_returnflag <> 'A')
"""


def _sides(spark, sf):
    li = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("feature_index"), "l_returnflag"
    )
    return li.filter("l_returnflag = 'A'").drop("l_returnflag"), li.filter("l_returnflag <> 'A'").drop("l_returnflag")


@query(
    "first_match_correspondence",
    roles.sql(
        SIDES_SQL,
        body="""
        , s AS (SELECT image_id, feature_index, max(point_id) AS sp FROM src GROUP BY 1, 2),
        t AS (SELECT image_id, feature_index, max(point_id) AS tp FROM tgt GROUP BY 1, 2),
        ip AS (SELECT s_suppkey AS image_id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS ord FROM supplier)
        SELECT sp AS source_point, tp AS target_point FROM s JOIN t USING (image_id, feature_index) JOIN ip USING (image_id)
        QUALIFY row_number() OVER (PARTITION BY sp ORDER BY ord, feature_index) = 1
        """,
    ),
)
def first_match_correspondence(spark, sf):
    src, tgt = _sides(spark, sf)
    pairs_of = roles.table(spark, sf, "supplier").select(
        F.struct("s_acctbal", "s_suppkey").alias("ord"), F.col("s_suppkey").alias("source_image"), F.col("s_suppkey").alias("target_image")
    )
    return M.correspondences_by_feature(src, tgt, pairs_of)


@query(
    "cross_point_resolution",
    roles.sql(
        SIDES_SQL,
        body="""
        , v AS (SELECT s.point_id, t.point_id AS target_point, count(*) AS votes FROM src s JOIN tgt t USING (image_id, feature_index) GROUP BY 1, 2)
        SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY votes DESC, target_point) = 1
        """,
    ),
)
def cross_point_resolution(spark, sf):
    return M.resolve_point(*_sides(spark, sf))


# Both sides see every observation: the target is the same table with keypoints nudged.
VOTES_SQL = """
tgt AS (SELECT point_id, image_id, x + 3.0 AS x, y - 2.0 AS y FROM obs),
cand AS (SELECT s.image_id, s.point_id AS sp, t.point_id AS tp, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) AS d2
         FROM obs s JOIN tgt t ON s.image_id = t.image_id AND abs(s.x - t.x) <= 12 AND abs(s.y - t.y) <= 12
         WHERE (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= 144.0),
bt AS (SELECT image_id, sp, tp FROM cand QUALIFY row_number() OVER (PARTITION BY image_id, sp ORDER BY d2, tp) = 1),
bs AS (SELECT image_id, sp, tp FROM cand QUALIFY row_number() OVER (PARTITION BY image_id, tp ORDER BY d2, sp) = 1),
votes AS (SELECT sp AS source_point, tp AS target_point, count(*) AS votes FROM bt JOIN bs USING (image_id, sp, tp) GROUP BY 1, 2)
"""


def _votes(spark, sf, min_votes):
    o = roles.obs(spark, sf).select("point_id", "image_id", "x", "y")
    t = o.withColumns({"x": F.col("x") + 3.0, "y": F.col("y") - 2.0})
    return M.mutual_coordinate_votes(o, t, 12.0, min_votes)


@query(
    "coordinate_votes",
    roles.sql(roles.OBS_SQL, VOTES_SQL, body="SELECT * FROM votes WHERE votes >= 1"),
)
def coordinate_votes(spark, sf):
    return _votes(spark, sf, 1)


# The pass over all votes in order, as a recursion: what is used so far is in two lists.
ONE_TO_ONE_SQL = """
ranked AS (SELECT *, row_number() OVER (ORDER BY votes DESC, source_point, target_point) AS k FROM votes WHERE votes >= 2),
pass AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS us, []::BIGINT[] AS ut, false AS took
  UNION ALL
  SELECT r.k, CASE WHEN ok THEN list_append(us, r.source_point) ELSE us END, CASE WHEN ok THEN list_append(ut, r.target_point) ELSE ut END, ok
  FROM (SELECT r.*, p.us, p.ut, NOT list_contains(p.us, r.source_point) AND NOT list_contains(p.ut, r.target_point) AS ok FROM pass p JOIN ranked r ON r.k = p.k + 1) r)
"""


@query(
    "coordinate_correspondence",
    roles.sql(roles.OBS_SQL, VOTES_SQL, ONE_TO_ONE_SQL, body="SELECT source_point, target_point, votes FROM ranked JOIN (SELECT k FROM pass WHERE took) USING (k)"),
)
def coordinate_correspondence(spark, sf):
    return M.greedy_one_to_one(_votes(spark, sf, 2))


EMB_SQL = """
emb AS (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS image_id, embedding AS descriptor, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
"""


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda k: ({a}[k]::DOUBLE - {b}[k]::DOUBLE) * ({a}[k]::DOUBLE - {b}[k]::DOUBLE)))"


# Every query lists twenty targets anywhere in the table; a listed row that doesn't exist is skipped.
LISTED_SQL = """
listed AS (SELECT q.row_id AS qid, k AS ord, (q.row_id * 13 + k * 17 + 1) % 409 AS cid, q.descriptor AS qd FROM emb q, (SELECT unnest(range(20)) AS k)),
c AS (SELECT qid, ord, cid, {d2} AS d2 FROM listed JOIN emb t ON t.row_id = cid),
b AS (SELECT qid, cid, d2 FROM c WHERE d2 <= trunc({t}::DOUBLE * {t}::DOUBLE) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, ord, cid) = 1)
"""
LISTED_THRESHOLD = 1.5


def _listed_sql() -> str:
    return LISTED_SQL.format(d2=_d2("qd", "t.descriptor"), t=LISTED_THRESHOLD)


def _best_listed(spark, sf):
    c = roles.corpus(spark, sf)
    q = c.select(F.col("row_id").alias("qid"), "descriptor")
    ord_ = F.explode(F.sequence(F.lit(0), F.lit(19)))
    listed = q.select("qid", ord_.alias("ord")).withColumn("cid", (F.col("qid") * 13 + F.col("ord") * 17 + 1) % 409)
    listed = listed.join(c.select(F.col("row_id").alias("cid"), "descriptor"), "cid")
    return M.best_candidates(q, listed, LISTED_THRESHOLD)


@query("best_candidate_match", roles.sql(EMB_SQL, _listed_sql(), body="SELECT qid, cid, round(d2, 6) AS d2 FROM b"))
def best_candidate_match(spark, sf):
    return _best_listed(spark, sf).select("qid", "cid", r6("d2", "d2"))


@query(
    "one_match_per_target",
    roles.sql(EMB_SQL, _listed_sql(), body="SELECT qid, cid, round(d2, 6) AS d2 FROM b QUALIFY row_number() OVER (PARTITION BY cid ORDER BY d2, qid) = 1"),
)
def one_match_per_target(spark, sf):
    return M.one_per_target(_best_listed(spark, sf)).select("qid", "cid", r6("d2", "d2"))


SWEEP_SQL = """
l AS (SELECT image_id AS pair, row_id AS fid, y, descriptor FROM emb),
r AS (SELECT (image_id + 9) % 10 AS pair, row_id AS fid, y, descriptor FROM emb),
lr AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY y, fid) - 1 AS k, count(*) OVER (PARTITION BY pair) AS n FROM l),
rr AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY y, fid) - 1 AS k, count(*) OVER (PARTITION BY pair) AS n FROM r)
"""


def _sweep_side(q: str, t: str, w: int, tag: str) -> str:
    return f"""
    mid_{tag} AS (SELECT pair, (y + lead(y, {w}) OVER (PARTITION BY pair ORDER BY k)) / 2.0 AS m FROM {t}),
    ws_{tag} AS (SELECT q.pair, q.fid, q.descriptor,
                        greatest(least((SELECT any_value(n) FROM {t} x WHERE x.pair = q.pair) - {w}, (SELECT count(*) FROM mid_{tag} m WHERE m.pair = q.pair AND m.m < q.y)), 0) AS s FROM {q} q),
    c_{tag} AS (SELECT a.pair, a.fid AS qid, b.fid AS cid, b.k, {_d2('a.descriptor', 'b.descriptor')} AS d2
                FROM ws_{tag} a JOIN {t} b ON a.pair = b.pair AND b.k BETWEEN a.s AND a.s + {w - 1}),
    best_{tag} AS (SELECT pair, qid, cid, d2 FROM c_{tag} QUALIFY row_number() OVER (PARTITION BY pair, qid ORDER BY d2, k) = 1)
    """


def _sweep_sides(spark, sf):
    c = roles.corpus(spark, sf).withColumn("y", F.col("descriptor")[1].cast("double"))
    left = c.select(F.col("image_id").alias("pair"), F.col("row_id").alias("fid"), "y", "descriptor")
    right = c.select(((F.col("image_id") + 9) % 10).alias("pair"), F.col("row_id").alias("fid"), "y", "descriptor")
    return left, right


@query(
    "sweep_match",
    roles.sql(EMB_SQL, SWEEP_SQL, _sweep_side("lr", "rr", 8, "a"), body="SELECT pair, qid, cid, round(d2, 6) AS d2 FROM best_a"),
)
def sweep_match(spark, sf):
    left, right = _sweep_sides(spark, sf)
    m = M.sweep_match(left.withColumnRenamed("fid", "qid"), right.withColumnRenamed("fid", "cid"), 8)
    return m.select("pair", "qid", "cid", r6("d2", "d2"))


@query(
    "mutual_sweep_match",
    roles.sql(
        EMB_SQL, SWEEP_SQL, _sweep_side("lr", "rr", 8, "a"), _sweep_side("rr", "lr", 8, "b"),
        body="""SELECT a.pair, a.qid AS l, a.cid AS r, round(a.d2, 6) AS d2 FROM best_a a
                JOIN best_b b ON a.pair = b.pair AND a.qid = b.cid AND a.cid = b.qid""",
    ),
)
def mutual_sweep_match(spark, sf):
    m = M.mutual_sweep_match(*_sweep_sides(spark, sf), 8)
    return m.select("pair", "l", "r", r6("d2", "d2"))


@query(
    "polar_rows",
    roles.sql(
        roles.OBS_SQL,
        body="""
        , p AS (SELECT image_id AS pair, point_id AS fid, atan2(y - 400.0, x - 500.0) AS theta,
                       sqrt((x - 500.0) * (x - 500.0) + (y - 400.0) * (y - 400.0)) AS r FROM obs),
        k AS (SELECT * FROM p WHERE r >= 25.0),
        m AS (SELECT *, least(pi() / 4, 2 * pi() * 12 / count(*) OVER (PARTITION BY pair)) AS margin FROM k)
        SELECT pair, fid, round(theta, 6) AS theta, 0 AS ghost FROM m
        UNION ALL SELECT pair, fid, round(theta + 2 * pi(), 6), 1 FROM m WHERE theta < -pi() + margin
        UNION ALL SELECT pair, fid, round(theta - 2 * pi(), 6), -1 FROM m WHERE theta > pi() - margin
        """,
    ),
)
def polar_rows(spark, sf):
    f = roles.obs(spark, sf).select(F.col("image_id").alias("pair"), F.col("point_id").alias("fid"), "x", "y")
    return M.polar_rows(f, F.lit(500.0), F.lit(400.0), 12, 25.0).select("pair", "fid", r6("theta", "theta"), "ghost")


@query(
    "cluster_pair_expansion",
    roles.sql(
        EMB_SQL,
        body=f"""
        , m AS (SELECT row_id // 5 AS cluster_id, image_id, min(row_id) AS feature_index FROM emb GROUP BY 1, 2),
        d AS (SELECT m.*, e.descriptor FROM m JOIN emb e ON e.row_id = m.feature_index)
        SELECT a.cluster_id, a.image_id AS i, b.image_id AS j, a.feature_index AS feature_i, b.feature_index AS feature_j,
               round(sqrt({_d2('a.descriptor', 'b.descriptor')}), 6) AS distance
        FROM d a JOIN d b ON a.cluster_id = b.cluster_id AND a.image_id < b.image_id
        """,
    ),
)
def cluster_pair_expansion(spark, sf):
    c = roles.corpus(spark, sf).withColumn("cluster_id", F.expr("row_id div 5"))
    m = c.groupBy("cluster_id", "image_id").agg(F.min_by(F.struct(F.col("row_id").alias("feature_index"), "descriptor"), "row_id").alias("b"))
    p = pairs.cluster_pair_matches(m.select("cluster_id", "image_id", "b.*"))
    return p.withColumn("distance", F.round("distance", 6))


@query(
    "pairwise_view",
    """
    WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS i, l_partkey AS f FROM lineitem)
    SELECT a.i AS i, b.i AS j, a.f AS feature_i, b.f AS feature_j, CAST('nan' AS DOUBLE) AS distance FROM m a JOIN m b ON a.c = b.c AND a.i < b.i
    """,
)
def pairwise_view(spark, sf):
    m = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("feature_index")
    ).distinct()
    return M.pairwise_view(None, m)


@query(
    "merge_min_distance",
    """
    WITH parts AS (
      SELECT 0 AS file, 'img/' || l_returnflag || l_suppkey AS a, 'img/' || l_linestatus || l_partkey % 50 AS b, l_linenumber AS fa, l_orderkey AS fb, l_extendedprice AS d FROM lineitem
      UNION ALL
      SELECT 1, 'img/' || l_linestatus || l_partkey % 50, 'img/' || l_returnflag || l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE l_extendedprice * 0.9 END FROM lineitem),
    ids AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id FROM (SELECT a AS n FROM parts UNION SELECT b FROM parts)),
    j AS (SELECT x.id AS i, y.id AS j, fa, fb, d FROM parts JOIN ids x ON x.n = a JOIN ids y ON y.n = b),
    s AS (SELECT least(i, j) AS i, greatest(i, j) AS j, CASE WHEN i > j THEN fb ELSE fa END AS feature_i, CASE WHEN i > j THEN fa ELSE fb END AS feature_j, d FROM j)
    SELECT i, j, feature_i, feature_j, round(coalesce(min(CASE WHEN NOT isnan(d) THEN d END), 'nan'), 4) AS distance FROM s GROUP BY 1, 2, 3, 4
    """,
)
def merge_min_distance(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    a = F.concat(F.lit("img\\"), "l_returnflag", F.col("l_suppkey").cast("string"))
    b = F.concat(F.lit("img/"), "l_linestatus", (F.col("l_partkey") % 50).cast("string"))
    fa, fb = F.col("l_linenumber").cast("long"), F.col("l_orderkey")
    one = li.select(F.lit(0).alias("file"), a.alias("name_i"), b.alias("name_j"), fa.alias("feature_i"), fb.alias("feature_j"), F.col("l_extendedprice").alias("distance"))
    two = li.select(
        F.lit(1).alias("file"), b.alias("name_i"), a.alias("name_j"), fb.alias("feature_i"), fa.alias("feature_j"),
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_extendedprice") * 0.9).alias("distance"),
    )
    return M.merge_pair_matches(one.unionByName(two)).withColumn("distance", F.round("distance", 4))


@query(
    "merge_two_view_best",
    """
    WITH p AS (SELECT l_linenumber AS file, l_suppkey AS i, l_partkey % 100 AS j, CAST(l_quantity AS INTEGER) AS inliers, l_returnflag AS config,
                      [1.0, l_discount, 2.0, l_tax, 3.0, 0.5, 0.25, 0.125, 4.0]::DOUBLE[] AS m FROM lineitem),
    u AS (SELECT file, least(i, j) AS i, greatest(i, j) AS j, inliers, config, CASE WHEN i > j THEN [m[1], m[4], m[7], m[2], m[5], m[8], m[3], m[6], m[9]] ELSE m END AS f,
                 i > j AS swapped, m FROM p),
    h AS (SELECT *, m[1] * (m[5] * m[9] - m[6] * m[8]) - m[2] * (m[4] * m[9] - m[6] * m[7]) + m[3] * (m[4] * m[8] - m[5] * m[7]) AS det FROM u),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY inliers DESC, file, config DESC, f DESC) = 1)
    SELECT i, j, inliers, round(f[2], 6) AS f01, round(CASE WHEN swapped THEN (m[5] * m[9] - m[6] * m[8]) / det ELSE m[1] END, 6) AS h00 FROM b
    """,
)
def merge_two_view_best(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    d = lambda v: F.lit(float(v))
    m = F.array(d(1), F.col("l_discount"), d(2), F.col("l_tax"), d(3), d(0.5), d(0.25), d(0.125), d(4))
    parts = li.select(
        F.col("l_linenumber").alias("file"), F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 100).alias("j"),
        F.col("l_returnflag").alias("config"), F.col("l_quantity").cast("int").alias("inliers"), m.alias("f"), m.alias("e"), m.alias("h"),
        F.array(d(1), d(0), d(0), d(0)).alias("q"), F.array(d(1), d(2), d(3)).alias("t"),
    )
    best = M.merge_two_view(parts)
    return best.select("i", "j", "inliers", r6(F.col("f")[1], "f01"), r6(F.col("h")[0], "h00"))


@query(
    "content_hash_conflicts",
    "SELECT p_name AS name, count(DISTINCT p_brand) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
)
def content_hash_conflicts(spark, sf):
    p = roles.table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_brand")
    return M.hash_conflicts(p, "name", "p_brand")


@query(
    "shared_images",
    "SELECT regexp_replace(a.url, '\\?.*$', '') AS name, a.page_id AS a_image, b.page_id AS b_image FROM pages a JOIN pages b ON regexp_replace(a.url, '\\?.*$', '') = regexp_replace(b.url, '\\?.*$', '')",
)
def shared_images(spark, sf):
    p = roles.table(spark, sf, "pages").select(F.col("page_id").alias("image_id"), F.regexp_replace("url", r"\?.*$", "").alias("name"))
    back = p.withColumn("name", F.replace("name", F.lit("/"), F.lit("\\")))
    return M.shared_images(p, back)


@query(
    "feature_usage_overlap",
    roles.sql(
        SIDES_SQL,
        body="""
        , a AS (SELECT DISTINCT image_id, feature_index, 1 AS in_a FROM src), b AS (SELECT DISTINCT image_id, feature_index, 1 AS in_b FROM tgt)
        SELECT image_id, count(CASE WHEN in_a = 1 AND in_b = 1 THEN 1 END) AS shared, count(CASE WHEN in_b IS NULL THEN 1 END) AS only_a,
               count(CASE WHEN in_a IS NULL THEN 1 END) AS only_b FROM a FULL JOIN b USING (image_id, feature_index) GROUP BY 1
        """,
    ),
)
def feature_usage_overlap(spark, sf):
    return M.feature_usage_overlap(*_sides(spark, sf))


@query(
    "merge_images_first_wins",
    """
    WITH i AS (SELECT 0 AS recon_id, page_id AS image_id, regexp_replace(url, '[?#].*$', '') AS name FROM pages
               UNION ALL SELECT 1, page_id + 1000000, regexp_replace(url, '^https?', 'http') FROM pages)
    SELECT name, recon_id, image_id FROM i QUALIFY row_number() OVER (PARTITION BY name ORDER BY recon_id, image_id) = 1
    """,
)
def merge_images_first_wins(spark, sf):
    p = roles.table(spark, sf, "pages")
    a = p.select(F.lit(0).alias("recon_id"), F.col("page_id").alias("image_id"), F.regexp_replace("url", "[?#].*$", "").alias("name"))
    b = p.select(F.lit(1).alias("recon_id"), (F.col("page_id") + 1000000).alias("image_id"), F.regexp_replace("url", "^https?", "http").alias("name"))
    return merge.merge_images(a.unionByName(b))


@query(
    "merge_cameras",
    """
    SELECT recon_id, camera_id, CAST(first_value(recon_id) OVER w AS INTEGER) AS into_recon, first_value(camera_id) OVER w AS into_camera
    FROM (SELECT p_size % 3 AS recon_id, p_partkey AS camera_id, p_type, p_brand FROM part)
    WINDOW w AS (PARTITION BY p_type, p_brand ORDER BY recon_id, camera_id)
    """,
)
def merge_cameras(spark, sf):
    c = roles.table(spark, sf, "part").select((F.col("p_size") % 3).alias("recon_id"), F.col("p_partkey").alias("camera_id"), "p_type", "p_brand")
    return merge.merge_cameras(c)
