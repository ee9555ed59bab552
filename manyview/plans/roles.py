"""The harness tables read as a reconstruction, once as DataFrames and once as SQL.

supplier = images, orders = points, lineitem = observations, nation = cameras,
events = frame sequences (user = sequence), embeddings = descriptor corpus
(label = image). Both sides state the same formulas so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import quat as Q
from ..operators.skew import global_rank


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


IMAGES_SQL = """
raw_images AS (
  SELECT s_suppkey AS image_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS camera_id,
         1.5 + cos(0.37 * s_suppkey) AS aw, sin(0.61 * s_suppkey) AS ax,
         sin(0.23 * s_suppkey + 1.0) AS ay, cos(0.11 * s_suppkey) AS az,
         5.0 * sin(0.13 * s_suppkey) AS tx, 5.0 * cos(0.29 * s_suppkey) AS ty,
         s_acctbal / 1000.0 AS tz
  FROM supplier),
images AS (
  SELECT image_id, name, camera_id, aw / n AS qw, ax / n AS qx, ay / n AS qy, az / n AS qz, tx, ty, tz
  FROM (SELECT *, sqrt(aw * aw + ax * ax + ay * ay + az * az) AS n FROM raw_images))
"""

CENTERS_SQL = """
poses AS (
  SELECT *, 1 - 2 * (qy * qy + qz * qz) AS r00, 2 * (qx * qy - qw * qz) AS r01, 2 * (qx * qz + qw * qy) AS r02,
         2 * (qx * qy + qw * qz) AS r10, 1 - 2 * (qx * qx + qz * qz) AS r11, 2 * (qy * qz - qw * qx) AS r12,
         2 * (qx * qz - qw * qy) AS r20, 2 * (qy * qz + qw * qx) AS r21, 1 - 2 * (qx * qx + qy * qy) AS r22
  FROM images),
centers AS (
  SELECT *, -(r00 * tx + r10 * ty + r20 * tz) AS cx, -(r01 * tx + r11 * ty + r21 * tz) AS cy,
         -(r02 * tx + r12 * ty + r22 * tz) AS cz
  FROM poses)
"""

POINTS_SQL = """
raw_points AS (
  SELECT o_orderkey AS point_id, o_totalprice / 50000.0 AS ax, (o_custkey % 100) / 10.0 AS ay,
         (o_orderkey % 97) / 10.0 + 0.05 AS az,
         CASE WHEN o_orderkey % 17 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS w,
         o_totalprice / 250000.0 AS error
  FROM orders),
points AS (
  SELECT point_id, CASE WHEN w = 0 THEN ax / n ELSE ax END AS x, CASE WHEN w = 0 THEN ay / n ELSE ay END AS y,
         CASE WHEN w = 0 THEN az / n ELSE az END AS z, w, error
  FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n FROM raw_points))
"""

OBS_SQL = """
obs AS (
  SELECT point_id, image_id, s.feature_index AS feature_index, s.x AS x, s.y AS y, s.residual AS residual,
         s.depth AS depth
  FROM (SELECT l_orderkey AS point_id, l_suppkey AS image_id,
               min(struct_pack(ln := l_linenumber, feature_index := l_partkey, x := l_quantity * 20.0,
                               y := l_extendedprice / 125.0, residual := l_discount,
                               depth := l_extendedprice / 1000.0)) AS s
        FROM lineitem GROUP BY 1, 2))
"""

FRAMES_SQL = """
frames AS (
  SELECT user_id AS seq, event_id, event_type, value, props,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)
"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = (
        1.5 + F.cos(0.37 * k),
        F.sin(0.61 * k),
        F.sin(0.23 * k + 1.0),
        F.cos(0.11 * k),
    )
    q = Q.normalize(raw)
    return table(spark, sf, "supplier").select(
        k.alias("image_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("long").alias("camera_id"),
        *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"))],
        (5.0 * F.sin(0.13 * k)).alias("tx"),
        (5.0 * F.cos(0.29 * k)).alias("ty"),
        (F.col("s_acctbal") / 1000.0).alias("tz"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("point_id"),
        (F.col("o_totalprice") / 50000.0).alias("ax"),
        ((F.col("o_custkey") % 100) / 10.0).alias("ay"),
        ((F.col("o_orderkey") % 97) / 10.0 + 0.05).alias("az"),
        F.when(F.col("o_orderkey") % 17 == 0, 0.0).otherwise(1.0).alias("w"),
        (F.col("o_totalprice") / 250000.0).alias("error"),
    )
    n = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    unit = [F.when(F.col("w") == 0, F.col(f"a{c}") / n).otherwise(F.col(f"a{c}")).alias(c) for c in "xyz"]
    return raw.select("point_id", *unit, "w", "error")


def obs(spark: SparkSession, sf: str, last: str = "depth") -> DataFrame:
    """The first row of each point and image; columns after ``last`` are left out, which changes no other."""
    fields = {
        "ln": F.col("l_linenumber"),
        "feature_index": F.col("l_partkey"),
        "x": F.col("l_quantity") * 20.0,
        "y": F.col("l_extendedprice") / 125.0,
        "residual": F.col("l_discount"),
        "depth": F.col("l_extendedprice") / 1000.0,
    }
    names = list(fields)[: list(fields).index(last) + 1]
    pick = F.min(F.struct(*[fields[n].alias(n) for n in names])).alias("s")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id"))
        .agg(pick)
        .select("point_id", "image_id", *[f"s.{n}" for n in names[1:]])
    )


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """(point_id, image_id) of every row, for operators that make them distinct themselves."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id"))


def track_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (point_id, image_id)."""
    return sightings(spark, sf).distinct()


def frames(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("seq"), "ts", "event_id", "event_type", "value", "props"
    )
    return global_rank(ev, ["ts", "event_id"], ["seq"], "pos").drop("ts")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptor rows: row id, image and the descriptor itself."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("image_id"), F.col("embedding").alias("descriptor")
    )


def harness_cameras(nation: DataFrame) -> DataFrame:
    """One camera per nation, cycling through five models."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    f = (500.0 + 10 * n).cast("double")
    kind = n % 5
    model = (
        F.when(kind == 0, "PINHOLE").when(kind == 1, "SIMPLE_RADIAL").when(kind == 2, "OPENCV")
        .when(kind == 3, "OPENCV_FISHEYE").otherwise("EQUIRECTANGULAR")
    )
    base = [F.lit("principal_point_x"), F.lit(500.0), F.lit("principal_point_y"), F.lit(400.0)]
    two = [F.lit("focal_length_x"), f, F.lit("focal_length_y"), f, *base]
    k1 = [F.lit("radial_distortion_k1"), 0.01 * (r + 1)]
    params = (
        F.when(kind == 1, F.create_map(F.lit("focal_length"), f, *base, *k1))
        .when(kind == 2, F.create_map(*two, *k1, F.lit("tangential_distortion_p1"), 0.001 * (r + 1)))
        .when(kind == 3, F.create_map(*two, *k1))
        .otherwise(F.create_map(*two))
    )
    return nation.select(
        n.cast("long").alias("camera_id"), model.alias("model"), F.lit(1000).alias("width"), F.lit(800).alias("height"), params.alias("params")
    )


def recon(spark: SparkSession, sf: str) -> model.Recon:
    return model.Recon(images(spark, sf), points(spark, sf), obs(spark, sf))


def sql(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip() for c in ctes) + " " + body
