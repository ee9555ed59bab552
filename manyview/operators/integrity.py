"""Integrity checks as one table of (check_name, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Recon


def content_hash(data: Column) -> Column:
    """Hex digest of a binary or string value."""
    return F.sha2(data, 256)


def stale_hashes(sections: DataFrame, stored: DataFrame) -> DataFrame:
    """Sections whose stored hash is missing or differs from their content's: (name, stored, computed)."""
    now = sections.select("name", content_hash(F.col("content")).alias("computed"))
    return now.join(stored.select("name", "stored"), "name", "left").filter(~F.col("computed").eqNullSafe(F.col("stored")))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def verify_reconstruction(recon: Recon, counts: DataFrame | None = None) -> DataFrame:
    """Foreign keys, duplicate keys, stored observation counts and unit directions."""
    obs, points, images = recon.obs, recon.points, recon.images
    checks = [
        _count(obs.join(points, "point_id", "left_anti"), "obs_without_point"),
        _count(obs.join(images, "image_id", "left_anti"), "obs_without_image"),
        _count(points.join(obs, "point_id", "left_anti"), "point_without_obs"),
        _count(points.groupBy("point_id").count().filter("count > 1"), "duplicate_point"),
        _count(images.groupBy("name").count().filter("count > 1"), "duplicate_image_name"),
        _count(obs.groupBy("point_id", "image_id").count().filter("count > 1"), "repeated_image_in_track"),
        _count(
            points.filter((F.col("w") == 0) & (F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 1.0) > 1e-6)),
            "infinity_not_unit",
        ),
    ]
    if counts is not None:
        real = obs.groupBy("point_id").agg(F.count(F.lit(1)).alias("real"))
        wrong = counts.join(real, "point_id", "full_outer").filter(~F.col("n").eqNullSafe(F.col("real")))
        checks.append(_count(wrong, "observation_count_mismatch"))
    return reduce(DataFrame.unionByName, checks)


def verify_matches(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pair order, repeated matches, one-to-one use, and one feature per image per cluster."""
    key = ["i", "j", "feature_i", "feature_j"]
    checks = [
        _count(pairs.filter("i >= j"), "pair_not_ordered"),
        _count(pairs.groupBy(*key).count().filter("count > 1"), "repeated_match"),
        _count(pairs.select(*key).distinct().groupBy("i", "j", "feature_i").count().filter("count > 1"), "left_feature_reused"),
        _count(members.groupBy("cluster_id", "image_id").count().filter("count > 1"), "two_features_in_image"),
        _count(members.groupBy("cluster_id").count().filter("count < 2"), "single_member_cluster"),
    ]
    return reduce(DataFrame.unionByName, checks)
