"""Differences between two reconstructions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import vec as V
from .matching import shared_images
from .metrics import with_centers

QN = ("qw", "qx", "qy", "qz")


def compare_extrinsics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Centre distance and rotation angle in degrees of every shared image."""
    cols = ("cx", "cy", "cz", *QN)
    left = with_centers(a).select(F.col("image_id").alias("a_image"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = with_centers(b).select(F.col("image_id").alias("b_image"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = shared_images(a, b).join(left, "a_image").join(right, "b_image")
    d = V.sub(V.vec("a_cx", "a_cy", "a_cz"), V.vec("b_cx", "b_cy", "b_cz"))
    turn = Q.mul(Q.quat(*[f"b_{c}" for c in QN]), Q.conj(Q.quat(*[f"a_{c}" for c in QN])))
    staged = j.select("name", "a_image", "b_image", V.norm(d).alias("center_distance"), *[c.alias(n) for c, n in zip(turn, QN)])
    return staged.select("name", "a_image", "b_image", "center_distance", F.degrees(Q.angle(Q.quat(*QN))).alias("rotation_deg"))


def compare_intrinsics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per camera and parameter the value on both sides and their difference (NULL where one side lacks it)."""
    left = a.select("camera_id", F.explode("params").alias("parameter", "a_value"))
    right = b.select("camera_id", F.explode("params").alias("parameter", "b_value"))
    return left.join(right, ["camera_id", "parameter"], "full_outer").withColumn("difference", F.col("b_value") - F.col("a_value"))


def compare_points(a: DataFrame, b: DataFrame, links: DataFrame) -> DataFrame:
    """Distance of every linked point pair. ``links`` is (source_point, target_point)."""
    s = a.filter("w <> 0").select(F.col("point_id").alias("source_point"), *[(F.col(c) / F.col("w")).alias(f"s{c}") for c in "xyz"])
    t = b.filter("w <> 0").select(F.col("point_id").alias("target_point"), *[(F.col(c) / F.col("w")).alias(f"t{c}") for c in "xyz"])
    d = V.norm(V.sub(V.vec("sx", "sy", "sz"), V.vec("tx", "ty", "tz")))
    return links.join(s, "source_point").join(t, "target_point").select("source_point", "target_point", d.alias("distance"))
