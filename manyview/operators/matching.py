"""Feature correspondences: by key, by coordinate and by descriptor."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..session import cut
from .graph import connected_components
from .skew import exact_quantiles, global_rank

#: Side of a tile of keypoints, in radii of the search.
VOTE_TILE = 4.0


def correspondences_by_feature(source: DataFrame, target: DataFrame, image_pairs: DataFrame) -> DataFrame:
    """(source_point, target_point) through shared image and feature.

    Inside one (image, feature) the last written point counts; per source point
    the first image pair (then the smallest feature) wins.
    ``image_pairs`` is (ord, source_image, target_image).
    """
    def last_write(df, side):
        return df.groupBy(F.col("image_id").alias(f"{side}_image"), "feature_index").agg(
            F.max("point_id").alias(f"{side}_point")
        )

    s = last_write(source, "source").join(image_pairs, "source_image")
    t = last_write(target, "target")
    hit = s.join(t, ["target_image", "feature_index"])
    return hit.groupBy("source_point").agg(
        F.min_by("target_point", F.struct("ord", "feature_index")).alias("target_point")
    )


def resolve_point(source: DataFrame, target: DataFrame) -> DataFrame:
    """Most common target point per source point over shared (image, feature); ties to the lowest id."""
    hit = source.join(target.withColumnRenamed("point_id", "target_point"), ["image_id", "feature_index"])
    votes = hit.groupBy("point_id", "target_point").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("point_id").agg(
        F.max_by(F.struct("target_point", "votes"), F.struct("votes", -F.col("target_point"))).alias("b")
    ).select("point_id", "b.target_point", "b.votes")


def mutual_coordinate_votes(source: DataFrame, target: DataFrame, radius: float, min_votes: int = 2) -> DataFrame:
    """Votes (source_point, target_point, votes) of mutual nearest keypoints within ``radius`` pixels.

    Tiles of ``VOTE_TILE`` radii turn the range join into an equi-join: a source keypoint visits the
    tiles its radius touches, mostly one or two.
    """
    tile = lambda c: F.floor(c / F.lit(VOTE_TILE * radius))
    wide = radius * (1.0 + 1e-6)
    touched = lambda c: F.explode(F.sequence(tile(F.col(c) - wide), tile(F.col(c) + wide)))
    s = source.select("image_id", F.col("point_id").alias("sp"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    s = s.withColumn("gx", touched("sx")).withColumn("gy", touched("sy"))
    t = target.select("image_id", F.col("point_id").alias("tp"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    t = t.withColumn("gx", tile(F.col("tx"))).withColumn("gy", tile(F.col("ty")))
    dx, dy = F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty")
    cand = (
        s.join(t, ["image_id", "gx", "gy"])
        .withColumn("d2", dx * dx + dy * dy)
        .filter(F.col("d2") <= radius * radius)
    )
    # Both sides' best from one pass; a pair that both name is mutual.
    named = [F.struct(F.lit(k).alias("side"), F.col(a).alias("id"), F.col(b).alias("other")) for k, (a, b) in enumerate((("sp", "tp"), ("tp", "sp")))]
    best = (
        cand.select("image_id", "d2", F.explode(F.array(*named)).alias("n"))
        .groupBy("image_id", "n.side", "n.id").agg(F.min(F.struct("d2", "n.other")).alias("b"))
    )
    from_source = F.col("side") == 0
    mutual = (
        best.groupBy("image_id", F.when(from_source, F.col("id")).otherwise(F.col("b.other")).alias("sp"), F.when(from_source, F.col("b.other")).otherwise(F.col("id")).alias("tp"))
        .agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    )
    return (
        mutual.groupBy(F.col("sp").alias("source_point"), F.col("tp").alias("target_point"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .filter(F.col("votes") >= min_votes)
    )


def greedy_one_to_one(votes: DataFrame) -> DataFrame:
    """One-to-one assignment taken by (votes desc, source, target).

    Each round accepts every pair that is the best left for both of its ends,
    which is what a sequential pass would accept, and drops what those ends block.
    """
    live = cut(votes.select("source_point", "target_point", "votes"))
    done = None
    while True:
        key = F.struct(-F.col("votes"), F.col("source_point"), F.col("target_point"))
        keyed = live.withColumn("k", key)
        by_s = keyed.groupBy("source_point").agg(F.min("k").alias("ks"))
        by_t = keyed.groupBy("target_point").agg(F.min("k").alias("kt"))
        won = cut(
            keyed.join(by_s, "source_point").join(by_t, "target_point")
            .filter((F.col("k") == F.col("ks")) & (F.col("k") == F.col("kt")))
            .select("source_point", "target_point", "votes")
        )
        done = won if done is None else done.unionByName(won)
        live = cut(
            live.join(won.select("source_point"), "source_point", "left_anti").join(
                won.select("target_point"), "target_point", "left_anti"
            )
        )
        if not live.limit(1).count():
            return done


def best_candidates(queries: DataFrame, candidates: DataFrame, threshold: float | None = None) -> DataFrame:
    """Nearest descriptor per query among its listed candidates, ties to the first listed.

    ``candidates`` is (qid, ord, cid, descriptor). The threshold is compared on
    squared distances after truncating its square to an integer.
    """
    j = queries.select("qid", F.col("descriptor").alias("_q")).join(candidates, "qid")
    j = j.withColumn("d2", V.l2_squared("_q", "descriptor"))
    if threshold is not None:
        j = j.filter(F.col("d2") <= F.lit(float(math.trunc(threshold * threshold))))
    return j.groupBy("qid").agg(F.min(F.struct("d2", "ord", "cid")).alias("b")).select(
        "qid", F.col("b.cid").alias("cid"), F.col("b.d2").alias("d2")
    )


def one_per_target(matches: DataFrame) -> DataFrame:
    """Keep the closest query per target, ties to the smaller query id."""
    return matches.groupBy("cid").agg(F.min(F.struct("d2", "qid")).alias("b")).select(
        F.col("b.qid").alias("qid"), "cid", F.col("b.d2").alias("d2")
    )


def sweep_candidates(queries: DataFrame, targets: DataFrame, window: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Sorted-Y sweep: each query meets ``window`` consecutive Y-sorted targets of its pair.

    queries (pair, qid, y), targets (pair, cid, y and ``ties``, which order equal y before
    the id). The window starts after every
    k with y[k] + y[k + window] < 2 q; both that count and the target ranks come
    from ranks over range partitions, then a join on (pair, rank).
    """
    t = global_rank(targets.select("pair", "cid", "y", *ties), ["y", *ties, "cid"], ["pair"], "trank")
    n = t.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    ahead = t.select("pair", (F.col("trank") - window).alias("trank"), F.col("y").alias("y2"))
    mids = t.join(ahead, ["pair", "trank"]).select(
        "pair", ((F.col("y") + F.col("y2")) / 2.0).alias("v"), F.lit(1).alias("side"), F.col("cid").alias("id")
    )
    qs = queries.select("pair", F.col("y").alias("v"), F.lit(0).alias("side"), F.col("qid").alias("id"))
    place = global_rank(qs.unionByName(mids), ["v", "side", "id"], ["pair"], "upos").filter("side = 0")
    qrank = global_rank(qs, ["v", "id"], ["pair"], "qrank").select("pair", "id", "qrank")
    ws = (
        place.join(qrank, ["pair", "id"]).join(n, "pair")
        .select(
            "pair", F.col("id").alias("qid"),
            F.greatest(F.least(F.col("n") - window, F.col("upos") - F.col("qrank")), F.lit(0)).alias("ws"),
        )
    )
    band = ws.withColumn("trank", F.explode(F.sequence(F.col("ws"), F.col("ws") + window - 1)))
    return band.join(t.select("pair", "trank", "cid"), ["pair", "trank"]).select(
        "pair", "qid", "cid", F.col("trank").alias("ord")
    )


def sweep_match(queries: DataFrame, targets: DataFrame, window: int, threshold: float | None = None) -> DataFrame:
    """One-way sweep match on descriptors: (pair, qid, cid, d2)."""
    cand = sweep_candidates(queries, targets, window)
    j = (
        cand.join(queries.select("pair", "qid", F.col("descriptor").alias("_q")), ["pair", "qid"])
        .join(targets.select("pair", "cid", F.col("descriptor").alias("_t")), ["pair", "cid"])
        .withColumn("d2", V.l2_squared("_q", "_t"))
    )
    if threshold is not None:
        j = j.filter(F.col("d2") <= float(threshold * threshold))
    return j.groupBy("pair", "qid").agg(F.min(F.struct("d2", "ord", "cid")).alias("b")).select(
        "pair", "qid", F.col("b.cid").alias("cid"), F.col("b.d2").alias("d2")
    )


def mutual_sweep_match(left: DataFrame, right: DataFrame, window: int, threshold: float | None = None) -> DataFrame:
    """Sweep matches that hold in both directions. Sides carry (pair, fid, y, descriptor)."""
    q = lambda df: df.withColumnRenamed("fid", "qid")
    c = lambda df: df.withColumnRenamed("fid", "cid")
    there = sweep_match(q(left), c(right), window, threshold).select("pair", F.col("qid").alias("l"), F.col("cid").alias("r"), "d2")
    back = sweep_match(q(right), c(left), window, threshold).select("pair", F.col("cid").alias("l"), F.col("qid").alias("r"))
    return there.join(back, ["pair", "l", "r"])


def polar_rows(features: DataFrame, ex, ey, window: int, min_radius: float) -> DataFrame:
    """Features by angle about the epipole, with ghost copies across the +-pi seam.

    The ghost margin is the smaller of pi/4 and the angle holding ``window`` rows on average.
    """
    dx, dy = F.col("x") - ex, F.col("y") - ey
    polar = (
        features.withColumn("r", F.sqrt(dx * dx + dy * dy))
        .filter(F.col("r") >= min_radius)
        .withColumn("theta", F.atan2(dy, dx))
    )
    n = polar.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    margin = F.least(F.lit(math.pi / 4), F.lit(2 * math.pi * window) / F.col("n"))
    p = polar.join(n, "pair").withColumn("margin", margin)
    low = p.filter(F.col("theta") < -math.pi + F.col("margin")).withColumn("theta", F.col("theta") + 2 * math.pi)
    high = p.filter(F.col("theta") > math.pi - F.col("margin")).withColumn("theta", F.col("theta") - 2 * math.pi)
    base = p.withColumn("ghost", F.lit(0))
    return (
        base.unionByName(low.withColumn("ghost", F.lit(1))).unionByName(high.withColumn("ghost", F.lit(-1))).drop("n", "margin")
    )


def merge_pair_matches(parts: DataFrame) -> DataFrame:
    """Union of match files on image names.

    ``parts`` is (file, name_i, name_j, feature_i, feature_j, distance). Names get
    dense ids in name order, pairs are swapped to i < j, and per match the known
    smallest distance wins over NaN.
    """
    path = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    p = parts.withColumn("name_i", path("name_i")).withColumn("name_j", path("name_j"))
    names = p.select(F.col("name_i").alias("name")).unionAll(p.select("name_j")).distinct()
    ids = global_rank(names, ["name"], out="id")
    p = (
        p.join(ids.select(F.col("name").alias("name_i"), F.col("id").alias("ii")), "name_i")
        .join(ids.select(F.col("name").alias("name_j"), F.col("id").alias("jj")), "name_j")
    )
    swap = F.col("ii") > F.col("jj")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    flat = p.select(
        pick("ii", "jj").alias("i"), pick("jj", "ii").alias("j"),
        pick("feature_i", "feature_j").alias("feature_i"), pick("feature_j", "feature_i").alias("feature_j"),
        "distance",
    )
    # NaN sorts above every number, so the minimum prefers known distances.
    return flat.groupBy("i", "j", "feature_i", "feature_j").agg(F.min("distance").alias("distance"))


def merge_two_view(parts: DataFrame) -> DataFrame:
    """Best two-view geometry per unordered pair: most inliers, ties to the first file and
    then to the largest remaining columns in order, so that the result is one of the rows.

    Swapped pairs transpose F and E, invert H and invert the relative pose.
    Matrices are arrays of nine in row order; pose is q (w, x, y, z) and t.
    """
    # Of a pair only the rows with most inliers in the first such file are brought to one direction.
    w = Window.partitionBy("_lo", "_hi").orderBy(F.col("inliers").desc(), F.col("file").asc_nulls_last())
    first = (
        parts.withColumns({"_lo": F.least("i", "j"), "_hi": F.greatest("i", "j")})
        .withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1).drop("_r")
    )
    swap = F.col("i") > F.col("j")
    tr = lambda m: F.array(*[F.element_at(m, k) for k in (1, 4, 7, 2, 5, 8, 3, 6, 9)])
    p = first.withColumn("_det", F.when(swap, _det3("h"))).select(
        "file",
        F.col("_lo").alias("i"), F.col("_hi").alias("j"), "config", "inliers",
        F.when(swap, tr("f")).otherwise(F.col("f")).alias("f"),
        F.when(swap, tr("e")).otherwise(F.col("e")).alias("e"),
        F.when(swap, _inverse3("h", F.col("_det"))).otherwise(F.col("h")).alias("h"),
        *_swapped_pose(swap),
    )
    rest = [c for c in p.columns if c not in ("i", "j")]
    return (
        p.groupBy("i", "j")
        .agg(F.max(F.struct("inliers", (-F.col("file")).alias("_first"), *[c for c in rest if c not in ("inliers", "file")])).alias("b"))
        .select("i", "j", *[f"b.{c}" for c in rest if c != "file"])
    )


def _det3(name: str):
    m = [F.element_at(name, k) for k in range(1, 10)]
    return m[0] * (m[4] * m[8] - m[5] * m[7]) + m[1] * (m[5] * m[6] - m[3] * m[8]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def _inverse3(name: str, det):
    m = [F.element_at(name, k) for k in range(1, 10)]
    cof = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    return F.when(F.abs(det) > 0, F.array(*[c / det for c in cof]))


def _swapped_pose(swap):
    from ..functions import quat as Q

    q = tuple(F.element_at("q", k) for k in range(1, 5))
    t = tuple(F.element_at("t", k) for k in range(1, 4))
    back = V.neg(Q.rotate_inverse(q, t))
    return (
        F.when(swap, F.array(*Q.conj(q))).otherwise(F.col("q")).alias("q"),
        F.when(swap, F.array(*back)).otherwise(F.col("t")).alias("t"),
    )


def hash_conflicts(parts: DataFrame, key: str, content: str) -> DataFrame:
    """Keys that arrive with more than one content hash."""
    return (
        parts.select(key, content).distinct()
        .groupBy(key).agg(F.count(F.lit(1)).alias("versions"))
        .filter(F.col("versions") > 1)
    )


def pairwise_view(pairs: DataFrame | None, members: DataFrame | None) -> DataFrame:
    """One pairwise table over whichever backbone exists; no descriptors means NaN distance."""
    from .pairs import cluster_pair_matches

    if pairs is not None:
        return pairs.select("i", "j", "feature_i", "feature_j", F.col("distance").cast("double").alias("distance"))
    if "descriptor" in members.columns:
        return cluster_pair_matches(members).drop("cluster_id")
    from .skew import self_pairs

    p = self_pairs(members.select("cluster_id", "image_id", "feature_index"), ["cluster_id"], "image_id")
    return p.select(
        F.col("a_image_id").alias("i"), F.col("b_image_id").alias("j"),
        F.col("a_feature_index").alias("feature_i"), F.col("b_feature_index").alias("feature_j"),
        F.lit(float("nan")).alias("distance"),
    )


def shared_images(a: DataFrame, b: DataFrame) -> DataFrame:
    """Images of two reconstructions with the same normalised name."""
    path = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    left = a.select(path("name").alias("name"), F.col("image_id").alias("a_image"))
    right = b.select(path("name").alias("name"), F.col("image_id").alias("b_image"))
    return left.join(right, "name")


def feature_usage_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per image: features used by both, only by the first, only by the second."""
    keys = ["image_id", "feature_index"]
    sa = a.select(*keys).distinct().withColumn("in_a", F.lit(1))
    sb = b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = sa.join(sb, keys, "full_outer")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.groupBy("image_id").agg(
        one(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"),
        one(F.col("in_b").isNull()).alias("only_a"),
        one(F.col("in_a").isNull()).alias("only_b"),
    )


def correspondence_groups(links: DataFrame, points: DataFrame, percentile: float) -> DataFrame:
    """Transitive groups of linked points, kept when their spread is within the percentile.

    ``links`` is (src, dst) over global point keys, ``points`` (key, x, y, z).
    Returns (root, n, spread, accepted) for groups of at least two points.
    """
    comp = connected_components(links)
    j = comp.join(points.withColumnRenamed("key", "node"), "node")
    mean = j.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz")
    ).filter(F.col("n") >= 2)
    d = V.norm(V.sub(V.vec("x", "y", "z"), V.vec("mx", "my", "mz")))
    spread = cut(j.join(mean, "root").groupBy("root").agg(F.max("n").alias("n"), F.max(d).alias("spread")))
    limit = exact_quantiles(spread, [], "spread", {"limit": percentile / 100.0})
    # One row: the global threshold.
    return spread.join(F.broadcast(limit), F.lit(True)).select(
        "root", "n", "spread", (F.col("spread") <= F.col("limit")).alias("accepted")
    )


def sensor_assignment(images: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """(image_id, sensor_id, frame_id) by rig patterns."""
    from ..functions.naming import frame_number

    hits = None
    for sensor, pattern in patterns:
        part = images.select("image_id", F.lit(sensor).cast("long").alias("sensor_id"), frame_number("name", pattern).alias("frame_id")).filter(
            F.col("frame_id").isNotNull()
        )
        hits = part if hits is None else hits.unionByName(part)
    return hits


def assignment_conflicts(hits: DataFrame) -> DataFrame:
    """Images claimed by several sensors and (sensor, frame) slots filled twice."""
    twice = hits.groupBy(F.col("image_id").cast("string").alias("what")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slot = hits.groupBy(F.concat_ws("/", "sensor_id", "frame_id").alias("what")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.withColumn("kind", F.lit("image")).unionByName(slot.withColumn("kind", F.lit("slot")))


def last_rank(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
