"""Descriptor clusters over a background-distance floor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .knn import self_knn


def floor_candidates(corpus: DataFrame, d: int = 10, alpha: float = 0.8, neighbours: DataFrame | None = None) -> DataFrame:
    """Cross-image neighbours closer than ``alpha`` x the distance of rank d + 1 (self counted).

    corpus is (row_id, image_id, descriptor); the result (seed, cand, dist, seed_image, cand_image).
    """
    nn = neighbours if neighbours is not None else self_knn(corpus, d + 1, "row_id", "descriptor", include_self=True)
    # The floor is taken beside the neighbours, so that these are searched once.
    floor = F.max(F.when(F.col("rank") == d + 1, F.col("dist"))).over(Window.partitionBy("row"))
    img = corpus.select("row_id", "image_id")
    return (
        nn.withColumn("radius", floor * alpha)
        .filter((F.col("nn") != F.col("row")) & (F.col("dist") <= F.col("radius")))
        .join(img.select(F.col("row_id").alias("row"), F.col("image_id").alias("seed_image")), "row")
        .join(img.select(F.col("row_id").alias("nn"), F.col("image_id").alias("cand_image")), "nn")
        .filter(F.col("seed_image") != F.col("cand_image"))
        .select(F.col("row").alias("seed"), F.col("nn").alias("cand"), "dist", "seed_image", "cand_image")
    )


def claim_clusters(rows: DataFrame, candidates: DataFrame, min_size: int = 2) -> DataFrame:
    """Density-ordered hard partition: (cluster_id, row_id, image_id, dist); cluster_id is the seed row.

    Seeds rank by (candidate count desc, row asc). In a round every live seed
    that outranks all live seeds sharing a live row with it is settled; seeds
    meet only through shared rows, so this is the sequential outcome. Each
    settled cluster keeps the nearest live candidate per image.
    """
    counts = candidates.groupBy("seed").agg((-F.count(F.lit(1))).alias("neg"))
    edges = candidates.select("seed", F.col("cand").alias("row"), F.col("cand_image").alias("image"), "dist")
    # A row without candidates that nobody lists can never join a cluster.
    listed = edges.select("seed").union(edges.select("row")).distinct()
    own = rows.select(F.col("row_id").alias("seed"), F.col("row_id").alias("row"), F.col("image_id").alias("image"), F.lit(0.0).alias("dist")).join(
        listed, "seed", "left_semi"
    )
    # One table of live (seed, touched row) pairs; every seed touches itself.
    live = cut(
        own.unionByName(edges).join(counts, "seed", "left")
        .select("seed", "row", "image", "dist", F.struct(F.coalesce("neg", F.lit(0)).alias("neg"), F.col("seed").alias("s")).alias("prio"))
    )
    kept = []
    while not live.isEmpty():
        best = live.groupBy("row").agg(F.min("prio").alias("best"))
        judged = live.join(best, "row")
        won = judged.groupBy("seed").agg(F.max((F.col("best") != F.col("prio")).cast("int")).alias("lost")).filter("lost = 0")
        nearest = (
            live.join(won.select("seed"), "seed")
            .groupBy("seed", "image").agg(F.min(F.struct("dist", "row")).alias("m"))
        )
        size = nearest.groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
        settled = cut(
            nearest.join(size, "seed").filter((F.col("size") >= min_size) | (F.col("m.row") == F.col("seed"))).select(
                F.col("seed").alias("cluster_id"), F.col("m.row").alias("row_id"), F.col("image").alias("image_id"),
                F.col("m.dist").alias("dist"), "size",
            )
        )
        kept.append(settled.filter(F.col("size") >= min_size).drop("size"))
        gone = settled.select(F.col("row_id").alias("row"))
        live = cut(
            live.join(gone, "row", "left_anti").join(gone.select(F.col("row").alias("seed")), "seed", "left_anti")
        )
    if not kept:
        return edges.select(F.col("seed").alias("cluster_id"), F.col("row").alias("row_id"), F.col("image").alias("image_id"), "dist").limit(0)
    return reduce(DataFrame.unionByName, kept)


def background_floor_clusters(corpus: DataFrame, d: int = 10, alpha: float = 0.8, min_size: int = 2) -> DataFrame:
    return claim_clusters(corpus, cut(floor_candidates(corpus, d, alpha)), min_size)
