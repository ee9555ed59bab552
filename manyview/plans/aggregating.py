"""Metrics, histograms and coverage on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera, stats
from ..operators import coverage, metrics
from . import roles
from .registry import query, r6

SCENE = (roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL)


@query("observation_counts", "SELECT l_orderkey AS point_id, count(*) AS n FROM lineitem GROUP BY 1")
def observation_counts(spark, sf):
    return metrics.observation_counts(roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("point_id")))


@query(
    "observation_offsets",
    """SELECT point_id, n, CAST(sum(n) OVER (ORDER BY point_id) - n AS BIGINT) AS start
       FROM (SELECT l_orderkey AS point_id, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def observation_offsets(spark, sf):
    return metrics.observation_offsets(roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("point_id")))


@query(
    "per_image_metrics",
    roles.sql(
        roles.OBS_SQL,
        body="""
        , len AS (SELECT point_id, count(*) AS len FROM obs GROUP BY 1),
        m AS (SELECT image_id, count(*) AS n, avg(residual) AS mean_e, median(residual) AS med_e, max(residual) AS max_e, avg(len) AS mean_len
              FROM obs JOIN len USING (point_id) GROUP BY 1),
        ref AS (SELECT median(o_totalprice / 5000000.0) AS ref FROM orders)
        SELECT s_suppkey AS image_id, s_name AS name, coalesce(n, 0) AS observation_count,
               round(coalesce(mean_e, 'nan'), 6) AS mean_error, round(coalesce(med_e, 'nan'), 6) AS median_error,
               round(coalesce(max_e, 'nan'), 6) AS max_error, round(coalesce(mean_len, 'nan'), 6) AS mean_track_length,
               CASE WHEN mean_e IS NULL THEN '' WHEN mean_e > 2.0 * ref THEN 'ALERT' WHEN mean_e > 1.5 * ref THEN 'WARN' ELSE '' END AS flag
        FROM supplier LEFT JOIN m ON image_id = s_suppkey, ref
        """,
    ),
)
def per_image_metrics(spark, sf):
    pts = roles.points(spark, sf).withColumn("error", F.col("error") / 20.0)
    m = metrics.per_image_metrics(roles.images(spark, sf), roles.obs(spark, sf), pts)
    return m.select(
        "image_id", "name", "observation_count",
        *[r6(c, c) for c in ("mean_error", "median_error", "max_error", "mean_track_length")], "flag",
    )


@query(
    "point_errors",
    roles.sql(roles.OBS_SQL, body="SELECT point_id, round(avg(residual), 6) AS error, count(residual) AS n FROM obs GROUP BY 1"),
)
def point_errors(spark, sf):
    return metrics.point_errors(roles.obs(spark, sf)).select("point_id", r6("error", "error"), "n")


DEPTHS_SQL = """
depths AS (
  SELECT o.image_id, o.point_id, p.w = 0 AS infinite,
         CASE WHEN p.w <> 0 THEN -(r20 * p.x / p.w + r21 * p.y / p.w + r22 * p.z / p.w + tz) END AS depth
  FROM obs o JOIN points p USING (point_id) JOIN poses USING (image_id)),
seen AS (SELECT image_id, depth FROM depths WHERE depth > 0)
"""


def scene_depths(spark, sf):
    return metrics.observed_depths(roles.images(spark, sf), roles.points(spark, sf), roles.track_pairs(spark, sf))


@query(
    "depth_statistics",
    roles.sql(
        *SCENE, DEPTHS_SQL,
        body="""
        , a AS (SELECT image_id, count(CASE WHEN depth > 0 THEN 1 END) AS n, CAST(sum(CASE WHEN infinite THEN 1 ELSE 0 END) AS BIGINT) AS n_inf,
                       min(CASE WHEN depth > 0 THEN depth END) AS mn, max(CASE WHEN depth > 0 THEN depth END) AS mx,
                       median(CASE WHEN depth > 0 THEN depth END) AS md, avg(CASE WHEN depth > 0 THEN depth END) AS av FROM depths GROUP BY 1)
        SELECT s_suppkey AS image_id, coalesce(n, 0) AS count, coalesce(n_inf, 0) AS infinity_count, round(mn, 6) AS min_z,
               round(mx, 6) AS max_z, round(md, 6) AS median_z, round(av, 6) AS mean_z
        FROM supplier LEFT JOIN a ON image_id = s_suppkey
        """,
    ),
)
def depth_statistics(spark, sf):
    d = metrics.depth_statistics(roles.images(spark, sf), scene_depths(spark, sf))
    return d.select("image_id", "count", "infinity_count", *[r6(c, c) for c in ("min_z", "max_z", "median_z", "mean_z")])


HIST_SQL = """
lim AS (SELECT image_id, min(depth) AS lo, max(depth) AS hi FROM obs GROUP BY 1),
hist AS (SELECT image_id, CAST(least(floor((depth - lo) / (hi - lo) * 128.0), 127) AS BIGINT) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS cnt
         FROM obs JOIN lim USING (image_id) WHERE lo < hi GROUP BY 1, 2)
"""


def _price_hist(spark, sf):
    return metrics.own_range_histogram(roles.obs(spark, sf).select("image_id", "depth"), ["image_id"], "depth")


@query("depth_histogram", roles.sql(roles.OBS_SQL, HIST_SQL, body="SELECT image_id, bin, cnt FROM hist"))
def depth_histogram(spark, sf):
    return _price_hist(spark, sf).select("image_id", F.col("bin").cast("long").alias("bin"), "cnt")


@query(
    "z_percentile",
    roles.sql(
        roles.OBS_SQL, HIST_SQL,
        body="""
        , c AS (SELECT *, sum(cnt) OVER (PARTITION BY image_id ORDER BY bin) AS cum, sum(cnt) OVER (PARTITION BY image_id) AS total FROM hist),
        h AS (SELECT * FROM c WHERE cum >= total * 0.95 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY bin) = 1)
        SELECT image_id, round(lo + (bin + 0.5) * ((hi - lo) / 128.0), 5) AS z_center,
               round(lo + (bin + (total * 0.95::DOUBLE - (cum - cnt)) / cnt) * ((hi - lo) / 128.0), 5) AS z_linear FROM h
        """,
    ),
)
def z_percentile(spark, sf):
    z = metrics.histogram_percentile(_price_hist(spark, sf), ["image_id"], 95.0)
    return z.select("image_id", r6("z_center", "z_center", 5), r6("z_linear", "z_linear", 5))


@query(
    "value_histogram",
    """
    WITH b AS (SELECT CAST(greatest(0, least(floor((value - 0.0) / (500.0 / 64)), 63)) AS BIGINT) AS bin FROM events)
    SELECT r.bin, coalesce(cnt, 0) AS cnt FROM (SELECT unnest(range(64)) AS bin) r LEFT JOIN (SELECT bin, count(*) AS cnt FROM b GROUP BY 1) g USING (bin)
    """,
)
def value_histogram(spark, sf):
    return metrics.fixed_histogram(roles.table(spark, sf, "events"), "value", 64, 0.0, 500.0)


@query(
    "histogram_bars",
    """
    WITH lim AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
    h AS (SELECT event_type, CAST(least(floor((value - lo) / (hi - lo) * 32.0), 31) AS BIGINT) AS bin, count(*) AS cnt
          FROM events JOIN lim USING (event_type) WHERE lo < hi GROUP BY 1, 2),
    l AS (SELECT *, greatest(1, floor(CAST(cnt AS DOUBLE) / max(cnt) OVER (PARTITION BY event_type) * 8)) AS level FROM h)
    SELECT event_type, string_agg(substr('▁▂▃▄▅▆▇█', CAST(level AS BIGINT), 1), '' ORDER BY bin) AS bar FROM l GROUP BY 1
    """,
)
def histogram_bars(spark, sf):
    h = metrics.own_range_histogram(roles.table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", 32)
    return metrics.bar(h, ["event_type"])


@query(
    "scene_scale",
    roles.sql(roles.POINTS_SQL, body="SELECT round(sqrt(var_pop(x / w) + var_pop(y / w) + var_pop(z / w)), 6) AS scale FROM points WHERE w <> 0"),
)
def scene_scale(spark, sf):
    s = metrics.scene_scale(roles.points(spark, sf), metrics.with_centers(roles.images(spark, sf)))
    return s.select(r6("scale", "scale"))


@query(
    "measured_scale",
    roles.sql(
        roles.POINTS_SQL,
        body="""
        , m AS (SELECT l_orderkey AS a, l_partkey AS b, max(l_extendedprice) / 10000.0 AS real FROM lineitem GROUP BY 1, 2),
        d AS (SELECT real, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS dist
              FROM m JOIN points p ON p.point_id = a JOIN points q ON q.point_id = b),
        r AS (SELECT CASE WHEN dist >= 1e-12 THEN real / dist END AS ratio FROM d),
        s AS (SELECT median(ratio) AS scale FROM r)
        SELECT round(scale, 6) AS scale, count(ratio) AS pairs, CAST(sum(CASE WHEN ratio IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS coincident,
               round(max(abs(ratio - scale) / scale), 5) AS max_deviation, max(abs(ratio - scale) / scale) > 0.05 AS warn
        FROM r, s GROUP BY scale
        """,
    ),
)
def measured_scale(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    m = li.groupBy(F.col("l_orderkey").alias("point_a"), F.col("l_partkey").alias("point_b")).agg(
        (F.max("l_extendedprice") / 10000.0).alias("real")
    )
    out = metrics.measured_scale(m, roles.points(spark, sf))
    return out.select(r6("scale", "scale"), "pairs", "coincident", r6("max_deviation", "max_deviation", 5), "warn")


FLOW_SQL = """
flow AS (SELECT l_suppkey AS pair_id, CAST(floor(l_quantity * 12.8) AS BIGINT) AS px, CAST(floor(l_extendedprice / 220.0) AS BIGINT) AS py,
                (l_discount - 0.05) * 4000.0 AS u, (l_tax - 0.04) * 4000.0 AS v FROM lineitem)
"""


def _flow(spark, sf):
    return roles.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pair_id"), F.floor(F.col("l_quantity") * 12.8).alias("px"), F.floor(F.col("l_extendedprice") / 220.0).alias("py"),
        ((F.col("l_discount") - 0.05) * 4000.0).alias("u"), ((F.col("l_tax") - 0.04) * 4000.0).alias("v"),
    )


@query(
    "flow_tile_means",
    roles.sql(
        FLOW_SQL,
        body="""SELECT pair_id, least(py // 160, 2) AS tile_row, least(px // 213, 2) AS tile_col, count(*) AS n,
                       round(avg(u), 6) AS mean_u, round(avg(v), 6) AS mean_v FROM flow GROUP BY 1, 2, 3""",
    ),
)
def flow_tile_means(spark, sf):
    t = metrics.flow_tiles(_flow(spark, sf), 640, 480, 3)
    return t.select("pair_id", F.col("tile_row").cast("long").alias("tile_row"), F.col("tile_col").cast("long").alias("tile_col"), "n", r6("mean_u", "mean_u"), r6("mean_v", "mean_v"))


@query(
    "flow_tile_magnitudes",
    roles.sql(
        FLOW_SQL,
        body="""SELECT pair_id, least(py // 160, 2) AS tile_row, least(px // 213, 2) AS tile_col,
                       round(median(sqrt(u * u + v * v)), 6) AS median_mag FROM flow GROUP BY 1, 2, 3""",
    ),
)
def flow_tile_magnitudes(spark, sf):
    t = metrics.flow_tile_magnitudes(_flow(spark, sf), 640, 480, 3)
    return t.select("pair_id", F.col("tile_row").cast("long").alias("tile_row"), F.col("tile_col").cast("long").alias("tile_col"), r6("median_mag", "median_mag"))


@query(
    "flow_histogram",
    roles.sql(
        FLOW_SQL,
        body="""
        , i AS (SELECT * FROM flow WHERE abs(u) <= 640.0 / 3.0 AND abs(v) <= 640.0 / 3.0),
        b AS (SELECT pair_id, CAST(floor((v + 640.0 / 3.0) / (2.0 * (640.0 / 3.0) / 6)) AS BIGINT) AS v_bin,
                     CAST(floor((u + 640.0 / 3.0) / (2.0 * (640.0 / 3.0) / 6)) AS BIGINT) AS u_bin FROM i)
        SELECT pair_id, v_bin, u_bin, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY pair_id), 6) AS percent FROM b GROUP BY 1, 2, 3
        """,
    ),
)
def flow_histogram(spark, sf):
    h = metrics.flow_histogram(_flow(spark, sf), 640, 480)
    return h.select("pair_id", F.col("v_bin").cast("long").alias("v_bin"), F.col("u_bin").cast("long").alias("u_bin"), r6("percent", "percent"))


DISKS_SQL = """
disks AS (SELECT image_id, x, y, 12.0 + residual * 200.0 AS radius FROM obs),
cells AS (
  SELECT image_id, x, y, radius, gx, gy FROM (
    SELECT *, unnest(range(CAST(greatest(floor((x - radius) / 32.0) - 1, 0) AS BIGINT), CAST(least(floor((x + radius) / 32.0) + 1, 31) AS BIGINT) + 1)) AS gx
    FROM disks) d, LATERAL (SELECT unnest(range(CAST(greatest(floor((d.y - d.radius) / 32.0) - 1, 0) AS BIGINT), CAST(least(floor((d.y + d.radius) / 32.0) + 1, 26) AS BIGINT) + 1)) AS gy)
  WHERE ((gx + 0.5) * 32.0 - x) * ((gx + 0.5) * 32.0 - x) + ((gy + 0.5) * 32.0 - y) * ((gy + 0.5) * 32.0 - y) <= radius * radius),
grid AS (SELECT image_id, gx, gy, least(count(*), 255) AS cnt FROM cells GROUP BY 1, 2, 3)
"""


def _disks(spark, sf):
    return roles.obs(spark, sf).select("image_id", "x", "y", (12.0 + F.col("residual") * 200.0).alias("radius"))


def _sizes(spark, sf):
    return roles.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(1024).alias("width"), F.lit(864).alias("height"))


@query("coverage_grid", roles.sql(roles.OBS_SQL, DISKS_SQL, body="SELECT image_id, gx, gy, CAST(cnt AS BIGINT) AS cnt FROM grid"))
def coverage_grid(spark, sf):
    return coverage.coverage_grid(_disks(spark, sf), _sizes(spark, sf), 32)


@query(
    "image_covered_fraction",
    roles.sql(
        roles.OBS_SQL, DISKS_SQL,
        body="""SELECT s_suppkey AS image_id, coalesce(n, 0) AS covered, round(coalesce(n, 0) / 864.0, 6) AS fraction
                FROM supplier LEFT JOIN (SELECT image_id, count(*) AS n FROM grid GROUP BY 1) ON image_id = s_suppkey""",
    ),
)
def image_covered_fraction(spark, sf):
    g = coverage.coverage_grid(_disks(spark, sf), _sizes(spark, sf), 32)
    return coverage.covered_fraction(g, _sizes(spark, sf), 32).select("image_id", "covered", r6("fraction", "fraction"))


@query(
    "coverage_queries",
    roles.sql(
        roles.OBS_SQL, DISKS_SQL,
        body="""
        , q AS (SELECT c_custkey AS query_id, c_custkey % (SELECT count(*) FROM supplier) AS image_id, (c_acctbal + 1000) / 10.0 AS x,
                       ((c_custkey * 37) % 864) + 0.25 AS y, 90.0 AS radius FROM customer),
        qc AS (SELECT query_id, image_id, gx, gy, (gx + 0.5) * 32.0 - x AS dx, (gy + 0.5) * 32.0 - y AS dy
               FROM q, (SELECT unnest(range(32)) AS gx), (SELECT unnest(range(27)) AS gy)
               WHERE ((gx + 0.5) * 32.0 - x) * ((gx + 0.5) * 32.0 - x) + ((gy + 0.5) * 32.0 - y) * ((gy + 0.5) * 32.0 - y) <= radius * radius),
        j AS (SELECT qc.*, cnt FROM qc LEFT JOIN grid USING (image_id, gx, gy)),
        a AS (SELECT query_id, avg(CASE WHEN cnt IS NULL THEN 0.0 ELSE 1.0 END) AS fraction,
                     bit_or(CASE WHEN cnt IS NULL AND NOT (dx = 0 AND dy = 0)
                                 THEN 1::BIGINT << (CAST(floor((atan2(dy, dx) / (2 * pi()) + 1.0) * 8) AS INTEGER) % 8) END) AS mask
              FROM j GROUP BY 1)
        SELECT c_custkey AS query_id, round(coalesce(fraction, 0.0), 6) AS fraction, coalesce(mask, 0) AS uncovered_mask
        FROM customer LEFT JOIN a ON query_id = c_custkey
        """,
    ),
)
def coverage_queries(spark, sf):
    n = roles.table(spark, sf, "supplier").count()
    q = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % n).alias("image_id"), ((F.col("c_acctbal") + 1000) / 10.0).alias("x"),
        ((F.col("c_custkey") * 37) % 864 + 0.25).alias("y"), F.lit(90.0).alias("radius"),
    )
    g = coverage.coverage_grid(_disks(spark, sf), _sizes(spark, sf), 32)
    return coverage.query_coverage(q, g, _sizes(spark, sf), 32, 8).select("query_id", r6("fraction", "fraction"), "uncovered_mask")


@query(
    "wilson_bounds",
    """
    WITH g AS (SELECT c_mktsegment AS grp, count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS k FROM customer GROUP BY 1)
    SELECT grp, n, k, round(greatest(((k::DOUBLE / n + 1.96 * 1.96 / (2.0 * n)) -
           1.96 * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 0.0), 6) AS lower_bound FROM g
    """,
)
def wilson_bounds(spark, sf):
    g = roles.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("k")
    )
    return g.select("grp", "n", "k", r6(stats.wilson_lower_bound(F.col("k"), F.col("n"), 1.96), "lower_bound"))


@query(
    "camera_table",
    """
    SELECT CAST(n_nationkey AS BIGINT) AS camera_id, CAST(500 + 10 * n_nationkey AS DOUBLE) AS fx, CAST(500 + 10 * n_nationkey AS DOUBLE) AS fy, CAST(500 AS DOUBLE) AS cx, CAST(400 AS DOUBLE) AS cy,
           n_nationkey % 5 IN (1, 2, 3) AS distorted FROM nation
    """,
)
def camera_table(spark, sf):
    cams = roles.harness_cameras(roles.table(spark, sf, "nation"))
    return cams.select("camera_id", *[e.cast("double").alias(n) for n, e in camera.intrinsics().items()], camera.has_distortion().alias("distorted"))


@query(
    "reconstruction_summary",
    roles.sql(
        roles.POINTS_SQL, roles.OBS_SQL,
        body="""
        SELECT 'error' AS measure, count(*) AS n, round(min(error), 6) AS min, round(avg(error), 6) AS mean, round(median(error), 6) AS median, round(max(error), 6) AS max FROM points
        UNION ALL
        SELECT 'track_length', count(*), min(n), round(avg(n), 6), median(n), max(n) FROM (SELECT point_id, CAST(count(*) AS DOUBLE) AS n FROM obs GROUP BY 1)
        """,
    ),
)
def reconstruction_summary(spark, sf):
    lens = metrics.observation_counts(roles.track_pairs(spark, sf)).select(F.col("n").cast("double").alias("v"))
    errs = roles.points(spark, sf).select(F.col("error").alias("v"))
    rows = errs.withColumn("measure", F.lit("error")).unionByName(lens.withColumn("measure", F.lit("track_length")))
    s = metrics.summarize(rows, "v", ["measure"])
    return s.select("measure", "n", *[r6(c, c) for c in ("min", "mean", "median", "max")])
