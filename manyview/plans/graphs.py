"""Graph, merge and adjacency queries on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import coverage, graph, matching, merge, metrics, pairs
from ..session import cut
from . import roles
from .pairing import SHARED_SQL
from .registry import query, r6

# Two observations of one (image, feature) tie their points together.
LINK_SQL = """
feat AS (SELECT DISTINCT l_orderkey AS p, l_suppkey AS i, l_partkey AS f FROM lineitem),
hub AS (SELECT i, f, min(p) AS h FROM feat GROUP BY 1, 2),
link AS (SELECT DISTINCT p AS src, h AS dst FROM feat JOIN hub USING (i, f) WHERE p <> h)
"""

COMPONENT_SQL = """
sym AS (SELECT src AS a, dst AS b FROM link UNION SELECT dst, src FROM link),
walk AS (SELECT DISTINCT a AS node, a AS root FROM sym UNION SELECT s.b, w.root FROM walk w JOIN sym s ON s.a = w.node),
comp AS (SELECT node, min(root) AS root FROM walk GROUP BY 1)
"""


def links(spark, sf, placed=None):
    if placed is not None:
        return placed.filter("key <> first").select(F.col("key").alias("src"), F.col("first").alias("dst")).distinct()
    f = roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("f")).distinct()
    hub = f.groupBy("i", "f").agg(F.min("p").alias("h"))
    return f.join(hub, ["i", "f"]).filter("p <> h").select(F.col("p").alias("src"), F.col("h").alias("dst")).distinct()


@query(
    "connected_groups",
    """
    WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey * 7 % 1009 AS dst FROM customer WHERE c_custkey * 7 % 1009 <> c_custkey),
    sym AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    walk AS (SELECT DISTINCT a AS node, a AS root FROM sym UNION SELECT s.b, w.root FROM walk w JOIN sym s ON s.a = w.node)
    SELECT node, min(root) AS root FROM walk GROUP BY 1
    """,
)
def connected_groups(spark, sf):
    c = roles.table(spark, sf, "customer")
    e = c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 7 % 1009).alias("dst")).filter("src <> dst")
    return graph.connected_components(e)


@query("track_components", roles.sql(LINK_SQL, COMPONENT_SQL, body="SELECT node, root FROM comp"))
def track_components(spark, sf):
    return graph.connected_components(links(spark, sf))


@query(
    "correspondence_groups",
    roles.sql(
        roles.POINTS_SQL, LINK_SQL, COMPONENT_SQL,
        body="""
        , j AS (SELECT root, x, y, z FROM comp JOIN points ON point_id = node),
        m AS (SELECT root, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM j GROUP BY 1 HAVING count(*) >= 2),
        s AS (SELECT root, any_value(n) AS n, max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) AS spread FROM j JOIN m USING (root) GROUP BY 1)
        SELECT root, n, round(spread, 6) AS spread, spread <= (SELECT quantile_cont(spread, 0.8) FROM s) AS accepted FROM s
        """,
    ),
)
def correspondence_groups(spark, sf):
    pts = roles.points(spark, sf).select(F.col("point_id").alias("key"), "x", "y", "z")
    g = matching.correspondence_groups(links(spark, sf), pts, 80.0)
    return g.select("root", "n", r6("spread", "spread"), "accepted")


MERGE_SQL = """
groups AS (SELECT src AS key, min(dst) AS gk FROM link GROUP BY 1),
pts AS (SELECT point_id AS key, x, y, z, error, (point_id % 256)::DOUBLE AS r, (point_id * 3 % 256)::DOUBLE AS g, (point_id * 5 % 256)::DOUBLE AS b FROM points),
tagged AS (SELECT *, coalesce(gk, key) AS part FROM pts LEFT JOIN groups USING (key)),
means AS (SELECT part, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(error) AS error, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM tagged GROUP BY 1),
part_obs AS (SELECT DISTINCT part, i, f FROM feat JOIN tagged ON key = p),
part_hub AS (SELECT i, f, min(part) AS h FROM part_obs GROUP BY 1, 2),
plink AS (SELECT DISTINCT part AS a, h AS b FROM part_obs JOIN part_hub USING (i, f) WHERE part <> h),
psym AS (SELECT a, b FROM plink UNION SELECT b, a FROM plink),
pwalk AS (SELECT DISTINCT a AS node, a AS root FROM psym UNION SELECT s.b, w.root FROM pwalk w JOIN psym s ON s.a = w.node),
pcomp AS (SELECT node, min(root) AS root FROM pwalk GROUP BY 1),
rooted AS (SELECT means.*, coalesce(root, part) AS root FROM means LEFT JOIN pcomp ON node = part),
ptracks AS (SELECT root, count(DISTINCT (i, f)) AS n_obs FROM part_obs JOIN rooted USING (part) GROUP BY 1)
"""


@query(
    "merge_points_and_tracks",
    roles.sql(
        roles.POINTS_SQL, LINK_SQL, MERGE_SQL,
        body="""
        SELECT root, CAST(avg(x) AS FLOAT) AS x, CAST(avg(y) AS FLOAT) AS y, CAST(avg(z) AS FLOAT) AS z, CAST(avg(error) AS FLOAT) AS error, CAST(round(round(avg(r), 6)) AS INTEGER) AS r,
               CAST(round(round(avg(g), 6)) AS INTEGER) AS g, CAST(round(round(avg(b), 6)) AS INTEGER) AS b, count(*) AS n_parts, coalesce(any_value(n_obs), 0) AS n_obs
        FROM rooted LEFT JOIN ptracks USING (root) GROUP BY root
        """,
    ),
)
def merge_points_and_tracks(spark, sf):
    pts, obs, groups = _merge_inputs(spark, sf)
    merged, tracks = merge.merge_points_and_tracks(pts, obs, groups)
    n = tracks.groupBy("root").agg(F.count(F.lit(1)).alias("n_obs"))
    return merged.join(n, "root", "left").select(
        "root", *[F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "error")], "r", "g", "b", "n_parts", F.coalesce("n_obs", F.lit(0)).alias("n_obs")
    )


def _merge_inputs(spark, sf):
    p = roles.points(spark, sf)
    pts = p.select(
        F.col("point_id").alias("key"), "x", "y", "z", (F.col("point_id") % 256).cast("double").alias("r"),
        (F.col("point_id") * 3 % 256).cast("double").alias("g"), (F.col("point_id") * 5 % 256).cast("double").alias("b"), "error",
    )
    obs = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("feature_index")
    )
    obs = merge.shared_observations(obs)
    groups = links(spark, sf, obs).groupBy(F.col("src").alias("key")).agg(F.min("dst").alias("group_key"))
    return pts, obs, groups


ADJ_SQL = """
o AS (SELECT ob.image_id, ob.point_id, ob.x, ob.y, 1.0 + ob.point_id % 3 AS radius,
             sqrt((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) + (p.z - c.cz) * (p.z - c.cz)) AS dist
      FROM obs ob
      JOIN points p USING (point_id) JOIN centers c USING (image_id) WHERE p.w <> 0),
near AS (SELECT DISTINCT a.point_id AS p, b.point_id AS q FROM o a JOIN o b ON a.image_id = b.image_id AND a.point_id < b.point_id
         AND abs(a.x - b.x) <= 10.0 * least(a.radius, b.radius) AND abs(a.y - b.y) <= 10.0 * least(a.radius, b.radius)
         WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN least(a.radius, b.radius) AND 10.0 * least(a.radius, b.radius)),
shared AS (SELECT p, q, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / least(a.radius, b.radius) AS ratio,
                  abs(a.dist - b.dist) / (0.5 * (a.dist + b.dist)) AS mism
           FROM near JOIN o a ON a.point_id = p JOIN o b ON b.point_id = q AND b.image_id = a.image_id),
agg AS (SELECT p, q, count(*) AS shared, count(CASE WHEN ratio BETWEEN 1 AND 10 THEN 1 END) AS hits, median(CASE WHEN ratio BETWEEN 1 AND 10 THEN ratio END) AS sep_median,
               median(mism) AS mismatch FROM shared GROUP BY 1, 2)
"""


def adjacency_input(spark, sf):
    o = roles.obs(spark, sf, last="y").select("point_id", "image_id", "x", "y")
    p = roles.points(spark, sf).filter("w <> 0").select("point_id", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    c = metrics.with_centers(roles.images(spark, sf)).select("image_id", "cx", "cy", "cz")
    d = V.norm(V.sub(V.vec("px", "py", "pz"), V.vec("cx", "cy", "cz")))
    return cut(
        o.join(p, "point_id").join(c, "image_id").select("image_id", "point_id", "x", "y", (1.0 + F.col("point_id") % 3).alias("radius"), d.alias("dist"))
    )


@query(
    "observation_adjacency",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL, ADJ_SQL,
        body="""SELECT p, q, shared, hits, round(sep_median, 5) AS sep_median, round(mismatch, 5) AS mismatch FROM agg
                WHERE shared >= 1 AND hits > 0 AND hits >= 0.5 * shared AND mismatch <= 0.2""",
    ),
)
def observation_adjacency(spark, sf):
    a = coverage.observation_adjacency(adjacency_input(spark, sf), min_shared=1, range_tol=0.2)
    return a.select("p", "q", "shared", "hits", r6("sep_median", "sep_median", 5), r6("mismatch", "mismatch", 5))


# The walk stated as a recursion over the list of live pairs, for groups of three.
SEED_SQL = """
el AS (SELECT list({'s': shared, 'i': i, 'j': j} ORDER BY shared DESC, i, j) AS l FROM shared WHERE shared >= 6),
walk AS (
  SELECT 0::BIGINT AS g, []::BIGINT[] AS used, []::BIGINT[] AS grp
  UNION ALL
  SELECT g + 1, list_concat(used, grp2), grp2 FROM (
    SELECT g, used, CASE WHEN len(found) = 0 THEN [top.i, top.j] ELSE [top.i, top.j, list_sort(found)[1].k] END AS grp2 FROM (
      SELECT *, list_transform(list_filter(li, lambda a: len(list_filter(lj, lambda b: b.k = a.k)) > 0), lambda a: {'w': -least(a.s, list_filter(lj, lambda b: b.k = a.k)[1].s), 'k': a.k}) AS found FROM (
        SELECT *,
          list_transform(list_filter(live, lambda e: (e.i = top.i AND e.j <> top.j) OR e.j = top.i), lambda e: {'k': CASE WHEN e.i = top.i THEN e.j ELSE e.i END, 's': e.s}) AS li,
          list_transform(list_filter(live, lambda e: (e.j = top.j AND e.i <> top.i) OR e.i = top.j), lambda e: {'k': CASE WHEN e.i = top.j THEN e.j ELSE e.i END, 's': e.s}) AS lj
        FROM (SELECT *, live[1] AS top FROM (
          SELECT g, used, list_filter(l, lambda e: NOT list_contains(used, e.i) AND NOT list_contains(used, e.j)) AS live FROM walk, el) WHERE len(live) > 0)))))
"""


@query(
    "seed_groups",
    roles.sql(SHARED_SQL, SEED_SQL, body="SELECT g - 1 AS group_no, unnest(grp) AS image_id FROM walk WHERE g > 0"),
)
def seed_groups(spark, sf):
    """All mutually covisible groups of three, strongest first."""
    shared = pairs.shared_counts(roles.sightings(spark, sf), "point_id")
    return pairs.seed_groups(shared, group_size=3, min_shared=6)
