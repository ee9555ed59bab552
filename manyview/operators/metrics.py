"""Aggregates over the observation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import vec as V
from ..session import cut
from .skew import exact_median, exact_quantiles

DEPTH_BINS = 128
# The eight block glyphs of a bar, lowest first.
BAR_BLOCKS = "▁▂▃▄▅▆▇█"


def observation_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


def observation_offsets(obs: DataFrame) -> DataFrame:
    """Exclusive running total of observation counts in point order.

    Counts are range partitioned by point; only per-range totals meet in one window.
    """
    r = cut(observation_counts(obs).repartitionByRange("point_id").withColumn("_pid", F.spark_partition_id()))
    totals = r.groupBy("_pid").agg(F.sum("n").alias("t"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_pid", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("_pid").orderBy("point_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        r.withColumn("cum", F.sum("n").over(inside))
        .join(F.broadcast(base), "_pid")  # one row per range
        .select("point_id", "n", (F.col("base") + F.col("cum") - F.col("n")).alias("start"))
    )


def per_image_metrics(images: DataFrame, obs: DataFrame, points: DataFrame, residual: str = "residual") -> DataFrame:
    """Observation count, mean/median/max error and mean track length per image, with a flag.

    Flags compare the mean error with the global median of point errors:
    above 2.0 x is ALERT, above 1.5 x is WARN. Images without observations stay, with NaN.
    """
    nan = F.lit(float("nan"))
    lengths = observation_counts(obs).withColumnRenamed("n", "len")
    err = F.when(~F.isnan(residual), F.col(residual))
    agg = (
        obs.join(lengths, "point_id")
        .groupBy("image_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(err).alias("mean_e"), F.max(err).alias("max_e"),
            F.avg("len").alias("mean_len"),
        )
    )
    med = exact_median(obs, ["image_id"], residual, "med_e")
    ref = exact_median(points, [], "error", "ref")
    mean = F.coalesce("mean_e", nan)
    flag = (
        F.when(F.isnan(mean), F.lit("")).when(mean > 2.0 * F.col("ref"), F.lit("ALERT"))
        .when(mean > 1.5 * F.col("ref"), F.lit("WARN")).otherwise(F.lit(""))
    )
    return (
        images.select("image_id", "name").join(agg, "image_id", "left").join(med, "image_id", "left")
        .join(F.broadcast(ref), F.lit(True))  # one row
        .select(
            "image_id", "name", F.coalesce("n", F.lit(0)).alias("observation_count"), mean.alias("mean_error"),
            F.coalesce("med_e", nan).alias("median_error"), F.coalesce("max_e", nan).alias("max_error"),
            F.coalesce("mean_len", nan).alias("mean_track_length"), flag.alias("flag"),
        )
    )


def observed_depths(images: DataFrame, points: DataFrame, obs: DataFrame) -> DataFrame:
    """(image_id, point_id, depth, infinite) over distinct observations; depth is -z in the camera."""
    pairs = obs.select("image_id", "point_id").distinct()
    w = F.col("w")
    p = points.select("point_id", "w", *[F.when(w != 0.0, F.col(c) / w).alias(f"p{c}") for c in "xyz"])
    pose = images.select("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    cam = Q.to_camera(Q.quat("qw", "qx", "qy", "qz"), V.vec("tx", "ty", "tz"), V.vec("px", "py", "pz"))
    return (
        pairs.join(p, "point_id").join(pose, "image_id")
        .select("image_id", "point_id", (-cam[2]).alias("depth"), (w == 0.0).alias("infinite"))
    )


def depth_statistics(images: DataFrame, depths: DataFrame) -> DataFrame:
    """Per image: counts and min/max/median/mean of the positive finite depths (NULL without any)."""
    d = F.when(~F.col("infinite") & (F.col("depth") > 0), F.col("depth"))
    agg = depths.groupBy("image_id").agg(
        F.count(d).alias("n"), F.sum(F.col("infinite").cast("long")).alias("n_inf"),
        F.min(d).alias("min_z"), F.max(d).alias("max_z"), F.avg(d).alias("mean_z"),
    )
    med = exact_median(depths.filter(~F.col("infinite") & (F.col("depth") > 0)), ["image_id"], "depth", "median_z")
    return (
        images.select("image_id").join(agg, "image_id", "left").join(med, "image_id", "left")
        .select(
            "image_id", F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("n_inf", F.lit(0)).alias("infinity_count"),
            "min_z", "max_z", "median_z", "mean_z",
        )
    )


def own_range_histogram(df: DataFrame, keys: list[str], value: str, bins: int = DEPTH_BINS) -> DataFrame:
    """Counts per bin between each group's own minimum and maximum: (keys, bin, cnt, lo, hi)."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    pos = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))
    binned = df.join(lim, keys).filter(F.col("lo") < F.col("hi")).withColumn("bin", F.least(F.floor(pos), F.lit(bins - 1)))
    return binned.groupBy(*keys, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("cnt"))


def fixed_histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """(bin, cnt) for all bins of [lo, hi]; values outside are clamped to the end bins."""
    pos = F.floor((F.col(value) - F.lit(lo)) / F.lit((hi - lo) / bins))
    binned = df.select(F.greatest(F.lit(0), F.least(pos, F.lit(bins - 1))).alias("bin"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    got = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def bar(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Unicode bar line of a histogram; bounded by the number of bins."""
    top = Window.partitionBy(*keys)
    share = F.floor(F.col("cnt") / F.max("cnt").over(top) * len(BAR_BLOCKS))
    level = F.when(F.col("cnt") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), share))
    glyph = F.when(level == 0, F.lit(" ")).otherwise(F.substring(F.lit(BAR_BLOCKS), level.cast("int"), 1))
    cells = hist.withColumn("g", glyph)
    return cells.groupBy(*keys).agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("bin", "g"))), lambda e: e["g"])).alias("bar")
    )


def histogram_percentile(hist: DataFrame, keys: list[str], p: float, bins: int = DEPTH_BINS) -> DataFrame:
    """Depth at a percentile of a histogram, by bin centre and by position within the bin.

    The target is the first bin whose running count reaches p/100 of the total.
    """
    w = Window.partitionBy(*keys)
    cum = hist.withColumn("cum", F.sum("cnt").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("cnt").over(w)
    )
    target = F.col("total") * F.lit(p / 100.0)
    hit = cum.filter(F.col("cum") >= target).groupBy(*keys).agg(
        F.min_by(F.struct("bin", "cum", "cnt", "total", "lo", "hi"), "bin").alias("h")
    )
    width = (F.col("h.hi") - F.col("h.lo")) / F.lit(float(bins))
    target = F.col("h.total") * F.lit(p / 100.0)
    inside = (target - (F.col("h.cum") - F.col("h.cnt"))) / F.col("h.cnt")
    return hit.select(
        *keys,
        (F.col("h.lo") + (F.col("h.bin") + 0.5) * width).alias("z_center"),
        (F.col("h.lo") + (F.col("h.bin") + inside) * width).alias("z_linear"),
    )


def point_errors(observed: DataFrame) -> DataFrame:
    """Mean residual per point, NaN residuals (behind the camera) left out."""
    e = F.when(~F.isnan("residual"), F.col("residual"))
    return observed.groupBy("point_id").agg(F.avg(e).alias("error"), F.count(e).alias("n"))


def scene_scale(points: DataFrame, centers: DataFrame) -> DataFrame:
    """RMS radius of the finite points, else of the camera centres, else 1."""
    def rms(df, cols):
        return F.sqrt(sum((F.var_pop(c) for c in cols[1:]), F.var_pop(cols[0])))

    finite = points.filter(F.col("w") != 0.0).select(*[(F.col(c) / F.col("w")).alias(c) for c in "xyz"])
    a = finite.agg(rms(finite, ["x", "y", "z"]).alias("a"))
    b = centers.agg(rms(centers, ["cx", "cy", "cz"]).alias("b"))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    # One row each.
    return a.join(F.broadcast(b), F.lit(True)).select(F.coalesce(pos("a"), pos("b"), F.lit(1.0)).alias("scale"))


def with_centers(images: DataFrame) -> DataFrame:
    c = Q.camera_center(Q.quat("qw", "qx", "qy", "qz"), V.vec("tx", "ty", "tz"))
    return images.select("*", *[e.alias(n) for e, n in zip(c, ("cx", "cy", "cz"))])


def summarize(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, min, mean, median and max of a column."""
    keys = keys or []
    base = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    agg = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    med = exact_quantiles(base, keys, value, {"median": 0.5})
    return agg.join(med, keys) if keys else agg.join(F.broadcast(med), F.lit(True))  # one row


def measured_scale(measures: DataFrame, points: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Scale from measured point pairs: median of real / reconstructed distance.

    ``measures`` is (measure_id, point_a, point_b, real). Coincident pairs are
    counted as errors; a deviation above ``tolerance`` of the scale raises the warning.
    """
    p = points.select("point_id", "x", "y", "z")
    a = p.select(F.col("point_id").alias("point_a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = p.select(F.col("point_id").alias("point_b"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = V.norm(V.sub(V.vec("ax", "ay", "az"), V.vec("bx", "by", "bz")))
    m = measures.join(a, "point_a").join(b, "point_b").withColumn("dist", d)
    ratios = m.withColumn("ratio", F.when(F.col("dist") >= 1e-12, F.col("real") / F.col("dist")))
    scale = exact_median(ratios, [], "ratio", "scale")
    # One row: the scale.
    j = ratios.join(F.broadcast(scale), F.lit(True))
    return j.groupBy("scale").agg(
        F.count("ratio").alias("pairs"), F.sum(F.col("ratio").isNull().cast("long")).alias("coincident"),
        F.max(F.abs(F.col("ratio") - F.col("scale")) / F.col("scale")).alias("max_deviation"),
    ).withColumn("warn", F.col("max_deviation") > tolerance)


def viewing_normals(rays: DataFrame) -> DataFrame:
    """Mean direction from each point back to its cameras, unit length."""
    m = rays.groupBy("point_id").agg(F.sum(-F.col("dx")).alias("sx"), F.sum(-F.col("dy")).alias("sy"), F.sum(-F.col("dz")).alias("sz"))
    n = V.norm(V.vec("sx", "sy", "sz"))
    return m.withColumn("n", n).filter("n > 0").select("point_id", *[(F.col(f"s{c}") / F.col("n")).alias(f"n{c}") for c in "xyz"])


def flow_tiles(flow: DataFrame, width: int, height: int, grid: int) -> DataFrame:
    """Mean flow per tile of a grid x grid layout; the last tile takes the remainder.

    ``flow`` is (pair_id, px, py, u, v).
    """
    tw, th = max(width // grid, 1), max(height // grid, 1)
    col = F.least(F.floor(F.col("px") / tw), F.lit(grid - 1))
    row = F.least(F.floor(F.col("py") / th), F.lit(grid - 1))
    m = flow.groupBy("pair_id", row.alias("tile_row"), col.alias("tile_col")).agg(
        F.avg("u").alias("mean_u"), F.avg("v").alias("mean_v"), F.count(F.lit(1)).alias("n")
    )
    return m.withColumn("magnitude", F.sqrt(F.col("mean_u") * F.col("mean_u") + F.col("mean_v") * F.col("mean_v")))


def flow_tile_magnitudes(flow: DataFrame, width: int, height: int, grid: int) -> DataFrame:
    """Median flow magnitude per tile."""
    tw, th = max(width // grid, 1), max(height // grid, 1)
    tiled = flow.select(
        "pair_id",
        F.least(F.floor(F.col("py") / th), F.lit(grid - 1)).alias("tile_row"),
        F.least(F.floor(F.col("px") / tw), F.lit(grid - 1)).alias("tile_col"),
        F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("mag"),
    )
    return exact_median(tiled, ["pair_id", "tile_row", "tile_col"], "mag", "median_mag")


def flow_histogram(flow: DataFrame, width: int, height: int, bins: int = 6) -> DataFrame:
    """Percentage of the in-range flow vectors per (v, u) bin over +- max(h, w) / 3."""
    lim = max(width, height) / 3.0
    def b(c: str) -> Column:
        k = F.floor((F.col(c) + lim) / (2.0 * lim / bins))
        return F.when(F.col(c) == lim, F.lit(bins - 1)).otherwise(k)

    inside = flow.filter((F.abs("u") <= lim) & (F.abs("v") <= lim))
    total = inside.groupBy("pair_id").agg(F.count(F.lit(1)).alias("total"))
    return (
        inside.groupBy("pair_id", b("v").alias("v_bin"), b("u").alias("u_bin")).agg(F.count(F.lit(1)).alias("n"))
        .join(total, "pair_id")
        .select("pair_id", "v_bin", "u_bin", (100.0 * F.col("n") / F.col("total")).alias("percent"))
    )
