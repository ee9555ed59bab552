"""Image-pair tables on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, pairs
from . import roles
from .registry import query, r6
from .selecting import SHARED_SQL

DIRS_SQL = """
dirs AS (SELECT image_id, -r20 AS vx, -r21 AS vy, -r22 AS vz FROM poses)
"""


def _members_xy(spark, sf):
    o = roles.obs(spark, sf)
    return o.select(F.col("point_id").alias("cluster_id"), "image_id", "feature_index", "x", "y")


@query(
    "covisibility_pairs",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, SHARED_SQL, DIRS_SQL,
        body="""SELECT i, j, shared FROM shared JOIN dirs a ON a.image_id = i JOIN dirs b ON b.image_id = j
                WHERE a.vx * b.vx + a.vy * b.vy + a.vz * b.vz >= cos(radians(90.0))""",
    ),
)
def covisibility_pairs(spark, sf):
    return pairs.covisibility(roles.sightings(spark, sf), roles.images(spark, sf), 90.0)


@query("cluster_covisibility", roles.sql(SHARED_SQL, body="SELECT * FROM shared"))
def cluster_covisibility(spark, sf):
    return pairs.shared_counts(roles.sightings(spark, sf), "point_id")


DISP_SQL = """
disp AS (SELECT a.image_id AS i, b.image_id AS j, count(*) AS shared,
                avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS mean_disp
         FROM obs a JOIN obs b ON a.point_id = b.point_id AND a.image_id < b.image_id GROUP BY 1, 2)
"""


@query(
    "pair_displacement",
    roles.sql(roles.OBS_SQL, DISP_SQL, body="SELECT i, j, shared, round(mean_disp, 5) AS mean_disp FROM disp"),
)
def pair_displacement(spark, sf):
    return pairs.mean_displacement(_members_xy(spark, sf)).select("i", "j", "shared", r6("mean_disp", "mean_disp", 5))


@query(
    "nearest_by_displacement",
    roles.sql(
        roles.OBS_SQL, DISP_SQL,
        body="""
        , sym AS (SELECT i AS image_id, j AS partner, mean_disp FROM disp UNION ALL SELECT j, i, mean_disp FROM disp)
        SELECT image_id, partner, round(mean_disp, 5) AS mean_disp, CAST(r AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mean_disp, partner) AS r FROM sym) WHERE r <= 3
        """,
    ),
)
def nearest_by_displacement(spark, sf):
    d = pairs.mean_displacement(_members_xy(spark, sf))
    return filters.top_partners(d, 3, "mean_disp", ascending=True).select(
        "image_id", "partner", r6("mean_disp", "mean_disp", 5), "rank"
    )


@query(
    "covisibility_ranking",
    roles.sql(
        SHARED_SQL,
        body="""
        , sym AS (SELECT i AS image_id, j AS partner, shared FROM shared UNION ALL SELECT j, i, shared FROM shared)
        SELECT image_id, partner, shared, CAST(r AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY shared DESC, partner) AS r FROM sym) WHERE r <= 5
        """,
    ),
)
def covisibility_ranking(spark, sf):
    return filters.top_partners(pairs.shared_counts(roles.sightings(spark, sf), "point_id"), 5, "shared")


@query(
    "reach_fraction",
    roles.sql(
        SHARED_SQL,
        body="""
        , part AS (SELECT s_suppkey AS image_id FROM supplier WHERE s_acctbal > 7000),
        hit AS (SELECT image_id FROM part UNION SELECT j FROM shared JOIN part ON image_id = i WHERE shared >= 15 UNION SELECT i FROM shared JOIN part ON image_id = j WHERE shared >= 15)
        SELECT count(*) AS reached, (SELECT count(*) FROM supplier) AS total, round(count(*) / (SELECT count(*) FROM supplier)::DOUBLE, 6) AS fraction FROM hit
        """,
    ),
)
def reach_fraction(spark, sf):
    """How much of the scene the images of the better suppliers see."""
    shared = pairs.shared_counts(roles.sightings(spark, sf), "point_id")
    part = roles.table(spark, sf, "supplier").filter("s_acctbal > 7000").select(F.col("s_suppkey").alias("image_id"))
    return pairs.reach_fraction(shared, roles.images(spark, sf), part, 15).select("reached", "total", r6("fraction", "fraction"))


# The sweep stated once more as a recursion: the state is the kept list so far.
THIN_SQL = """
near AS (SELECT image_id, min(mean_disp) AS d FROM (SELECT i AS image_id, mean_disp FROM disp UNION ALL SELECT j, mean_disp FROM disp) GROUP BY 1),
keyed AS (SELECT s_suppkey AS image_id, row_number() OVER (ORDER BY round(-coalesce(d, 'inf'), 6), s_suppkey) AS k FROM supplier LEFT JOIN near ON image_id = s_suppkey),
sym AS (SELECT i AS image_id, j AS other, shared FROM shared UNION ALL SELECT j, i, shared FROM shared),
rows_of AS (SELECT k, keyed.image_id, map_from_entries(list((other, shared))) AS m FROM keyed LEFT JOIN sym USING (image_id) GROUP BY 1, 2),
sweep AS (
  SELECT k, [image_id] AS kept FROM keyed WHERE k = 1
  UNION ALL
  SELECT r.k, CASE WHEN b >= {tau} / 8.0 AND b < {tau} THEN list_append(kept, r.image_id) ELSE kept END
  FROM (SELECT r.k, r.image_id, s.kept,
               list_max(list_transform(s.kept, lambda x: coalesce(element_at(r.m, x)[1], 0))) AS b
        FROM sweep s JOIN rows_of r ON r.k = s.k + 1) r)
"""


def _sweep_order(spark, sf):
    from ..operators.skew import global_rank

    o = pairs.isolation_order(pairs.mean_displacement(_members_xy(spark, sf)), roles.images(spark, sf))
    o = o.select("image_id", F.round(-F.col("isolation"), 6).alias("v"))
    return global_rank(o, ["v", "image_id"], out="rank").select("image_id", "rank")


@query(
    "redundancy_thinning",
    roles.sql(
        SHARED_SQL, roles.OBS_SQL, DISP_SQL, THIN_SQL.format(tau="20.0"),
        body="SELECT unnest(kept) AS image_id FROM (SELECT kept FROM sweep ORDER BY k DESC LIMIT 1)",
    ),
)
def redundancy_thinning(spark, sf):
    shared = pairs.shared_counts(roles.sightings(spark, sf), "point_id")
    return pairs.thin(shared, _sweep_order(spark, sf), 20.0)


@query(
    "rig_same_frame_pairs",
    """
    WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS rig_id, c_custkey // 25 AS frame_id, c_custkey AS image_id FROM customer)
    SELECT a.rig_id, a.image_id AS i, b.image_id AS j FROM c a JOIN c b ON a.rig_id = b.rig_id AND a.frame_id = b.frame_id AND a.image_id < b.image_id
    """,
)
def rig_same_frame_pairs(spark, sf):
    return pairs.rig_pairs(_rig_frames(spark, sf), same_frame=True)


@query(
    "rig_cross_frame_pairs",
    """
    WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS rig_id, c_custkey // 25 AS frame_id, c_custkey AS image_id FROM customer)
    SELECT a.rig_id, least(a.image_id, b.image_id) AS i, greatest(a.image_id, b.image_id) AS j
    FROM c a JOIN c b ON a.rig_id = b.rig_id AND b.frame_id - a.frame_id BETWEEN 1 AND 3
    """,
)
def rig_cross_frame_pairs(spark, sf):
    return pairs.rig_pairs(_rig_frames(spark, sf), same_frame=False, k=3)


def _rig_frames(spark, sf):
    return roles.table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("rig_id"), F.expr("c_custkey div 25").alias("frame_id"), F.col("c_custkey").alias("image_id")
    )


@query(
    "sequential_pairs",
    roles.sql(
        roles.FRAMES_SQL,
        body="""SELECT a.seq, a.pos AS a_pos, b.pos AS b_pos, a.event_id AS a_event_id, b.event_id AS b_event_id
                FROM frames a JOIN frames b ON a.seq = b.seq AND b.pos - a.pos BETWEEN 1 AND 5""",
    ),
)
def sequential_pairs(spark, sf):
    return pairs.band_pairs(roles.frames(spark, sf), ["seq"], "pos", 5, ["event_id"])


@query(
    "rig_sensor_assignment",
    """
    WITH h AS (SELECT s_suppkey AS image_id, CAST(0 AS BIGINT) AS sensor_id, CAST(regexp_extract(s_name, '^Supplier#(\\d{9,})$', 1) AS BIGINT) AS frame_id
               FROM supplier WHERE regexp_matches(s_name, '^Supplier#(\\d{9,})$'))
    SELECT * FROM h
    UNION ALL SELECT c_custkey, 1, CAST(regexp_extract(c_name, '^Customer#(\\d+)$', 1) AS BIGINT) FROM customer WHERE regexp_matches(c_name, '^Customer#(\\d+)$')
    """,
)
def rig_sensor_assignment(spark, sf):
    from ..operators.matching import sensor_assignment

    s = roles.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("name"))
    c = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"))
    return sensor_assignment(s.unionByName(c), [(0, "Supplier#%09d"), (1, "Customer#%d")])


@query(
    "rig_assignment_conflicts",
    """
    WITH h AS (SELECT page_id AS image_id, CAST(1 AS BIGINT) AS sensor_id, CAST(regexp_extract(url, '/en/(\\d+)', 1) AS BIGINT) AS frame_id
               FROM pages WHERE regexp_matches(url, '^https?://[^/]*/en/\\d+$')),
    slots AS (SELECT concat_ws('/', sensor_id, frame_id) AS what, count(*) AS n, 'slot' AS kind FROM h GROUP BY 1 HAVING count(*) > 1)
    SELECT what, n, kind FROM slots
    """,
)
def rig_assignment_conflicts(spark, sf):
    from ..operators.matching import assignment_conflicts

    url = F.col("url")
    hits = roles.table(spark, sf, "pages").filter(url.rlike(r"^https?://[^/]*/en/\d+$")).select(
        F.col("page_id").alias("image_id"), F.lit(1).cast("long").alias("sensor_id"), F.regexp_extract(url, r"/en/(\d+)", 1).cast("long").alias("frame_id")
    )
    return assignment_conflicts(hits)
