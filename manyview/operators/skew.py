"""Shapes that keep one hot key from landing in one task.

Every helper here splits work by a column computed from the data, so that a
group holding a third of all rows is spread over many tasks, and none of them
drops or samples rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

PAIR_BLOCK = 1024
CHUNK = 4096
# Rows of a partition where their number is set, so that a task's memory doesn't follow the input.
PART_ROWS = 1 << 20


def self_pairs(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    block: int = PAIR_BLOCK,
    condition: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Pairs ``a.item < b.item`` inside each group, in cells of at most block x block.

    A group of n rows is hashed (by whole rows, so that an item that repeats is spread too)
    into ceil(n / block) blocks; row r of block k
    visits the cells (min(k, m), max(k, m)) of the triangle, so the work of a hot
    group is spread evenly. Ordinary groups have one block and are not copied.
    ``condition`` (over ``a_*`` and ``b_*`` columns) is evaluated inside the join.
    ``parts`` (``pair_parts``) deals the cells to as many tasks; else adaptive execution decides.
    Columns come back as the group columns plus ``a_<col>`` and ``b_<col>``.
    """
    group = list(group)
    rest = [c for c in df.columns if c not in group]
    heavy = (
        df.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > block)
        .select(*group, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_nb"))
    )
    sized = df.join(F.broadcast(heavy), group, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    blk = F.pmod(F.xxhash64(*rest), F.col("_nb").cast("long")).cast("int")
    celled = (
        sized.withColumn("_blk", blk)
        .withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("_lo", F.least("_blk", "_m"))
        .withColumn("_hi", F.greatest("_blk", "_m"))
        .drop("_nb", "_m")
    )
    keys = [*group, "_lo", "_hi"]
    if parts is not None:
        celled = celled.repartition(parts, *keys)
    a = celled.select(*keys, F.col("_blk").alias("_ab"), *[F.col(c).alias(f"a_{c}") for c in rest])
    b = celled.select(*keys, F.col("_blk").alias("_bb"), *[F.col(c).alias(f"b_{c}") for c in rest])
    on = (F.col(f"a_{item}") < F.col(f"b_{item}")) & (
        (F.col("_lo") == F.col("_hi")) | (F.col("_ab") != F.col("_bb"))
    )
    if condition is not None:
        on = on & condition
    return a.join(b, keys).filter(on).drop("_lo", "_hi", "_ab", "_bb")


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions of at most ``PART_ROWS`` rows on average, and one a core at least."""
    return max(-(-rows // PART_ROWS), spark.sparkContext.defaultParallelism)


def pair_parts(df: DataFrame, group: Sequence[str], block: int = PAIR_BLOCK) -> int:
    """Partitions for the cells of ``self_pairs``, whose rows are counted with their copies."""
    n = F.col("_n")
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return parts_for(df.sparkSession, sizes.agg(F.sum(n * F.ceil(n / F.lit(block)))).first()[0] or 0)


def global_rank(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """Dense 0-based position by ``order`` within ``keys``, without one task per key.

    Range-partition by (keys, order), number rows inside each range, then add the
    row counts of the earlier ranges. Only (range, key) counts meet in a window.
    ``order`` must be a total order within ``keys``.
    """
    keys, order = list(keys), list(order)
    ranged = cut(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_pid", F.spark_partition_id())
    )
    counts = ranged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_pid").orderBy(*order)
    return (
        ranged.withColumn("_rn", F.row_number().over(local))
        .join(F.broadcast(offsets) if not keys else offsets, [*keys, "_pid"])
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_pid", "_rn", "_off")
    )


def halo_chunks(
    df: DataFrame, pos: str, before: int, after: int, chunk: int = CHUNK
) -> DataFrame:
    """Cut long sequences into chunks that each carry the neighbours a frame needs.

    Adds ``_chunk`` and ``_own``. A row is copied into every chunk in which one of
    its neighbours within ``before`` predecessors or ``after`` successors lives;
    windows over (sequence, ``_chunk``) are then exact for rows with ``_own``.
    """
    p = F.col(pos)
    first = F.floor(F.greatest(p - F.lit(after), F.lit(0)) / F.lit(chunk))
    last = F.floor((p + F.lit(before)) / F.lit(chunk))
    return (
        df.withColumn("_chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("_own", F.col("_chunk") == F.floor(p / F.lit(chunk)))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, for keys of any size.

    Equal values are first counted together, the (key, value) counts are range
    partitioned, and running counts locate the two ranks each quantile needs.
    NULL and NaN values are left out.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranged = cut(
        counted.repartitionByRange(*[F.col(c) for c in keys], F.col("_v")).withColumn(
            "_pid", F.spark_partition_id()
        )
    )
    per_range = ranged.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_rc"))
    w_all = Window.partitionBy(*keys)
    w_before = w_all.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        "_pid",
        F.coalesce(F.sum("_rc").over(w_before), F.lit(0)).alias("_off"),
        F.sum("_rc").over(w_all).alias("_n"),
    )
    local = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("_cum", F.sum("_c").over(local))
        .join(offsets, [*keys, "_pid"])
        .withColumn("_end", F.col("_off") + F.col("_cum"))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    aggs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("_start") <= rank) & (rank < F.col("_end"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{tag}"))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    outs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return found.select(*keys, *outs)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5})
