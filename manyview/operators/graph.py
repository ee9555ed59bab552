"""Iterative graph operators on edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) with root = smallest node id reachable.

    Alternating large-star / small-star rounds: each node only learns a minimum
    (a partial aggregate), so hubs cost no more than their edges, and the number
    of rounds grows with the logarithm of the graph, not its diameter.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    both = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = cut(both)
    signature = None
    while True:
        cur = cut(_small_star(_large_star(cur)))
        stats = cur.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        now = (stats["n"], stats["h"])
        if now == signature:
            break
        signature = now
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        sym.filter("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
