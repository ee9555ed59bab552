"""Covisibility and other image-pair tables."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import vec as V
from ..session import cut
from .graph import connected_components
from .skew import global_rank, pair_parts, parts_for, self_pairs


def shared_counts(rows: DataFrame, group: str, image: str = "image_id", out: str = "shared") -> DataFrame:
    """Groups shared by each image pair i < j; a group counts once per pair.

    Partitions are set by the number of rows, so that no task holds more of them on a larger input.
    """
    rows = rows.select(group, image)
    distinct = cut(rows.repartition(parts_for(rows.sparkSession, rows.count()), group, image).distinct())
    return (
        self_pairs(distinct, [group], image, parts=pair_parts(distinct, [group]))
        .groupBy(F.col(f"a_{image}").alias("i"), F.col(f"b_{image}").alias("j"))
        .agg(F.count(F.lit(1)).alias(out))
    )


def covisibility(obs: DataFrame, images: DataFrame, max_angle_deg: float = 90.0) -> DataFrame:
    """Image pairs sharing points whose viewing directions differ by at most the angle."""
    counts = shared_counts(obs, "point_id")
    d = Q.view_direction(Q.quat("qw", "qx", "qy", "qz"))
    dirs = images.select("image_id", *[c.alias(n) for c, n in zip(d, ("vx", "vy", "vz"))])
    a = dirs.select(F.col("image_id").alias("i"), *[F.col(c).alias(f"a{c}") for c in ("vx", "vy", "vz")])
    b = dirs.select(F.col("image_id").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("vx", "vy", "vz")])
    cosine = V.dot(V.vec("avx", "avy", "avz"), V.vec("bvx", "bvy", "bvz"))
    return (
        counts.join(a, "i").join(b, "j")
        .filter(cosine >= math.cos(math.radians(max_angle_deg)))
        .select("i", "j", "shared")
    )


def cluster_pair_matches(members: DataFrame) -> DataFrame:
    """Each cluster's member pairs across images with the descriptor distance."""
    pairs = self_pairs(members, ["cluster_id"], "image_id")
    return pairs.select(
        "cluster_id",
        F.col("a_image_id").alias("i"), F.col("b_image_id").alias("j"),
        F.col("a_feature_index").alias("feature_i"), F.col("b_feature_index").alias("feature_j"),
        F.sqrt(V.l2_squared("a_descriptor", "b_descriptor")).alias("distance"),
    )


def mean_displacement(members: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Mean keypoint displacement of every covisible pair: (i, j, shared, mean_disp)."""
    pairs = self_pairs(members.select(group, "image_id", "x", "y"), [group], "image_id")
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    return pairs.groupBy(F.col("a_image_id").alias("i"), F.col("b_image_id").alias("j")).agg(
        F.count(F.lit(1)).alias("shared"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("mean_disp")
    )


def band_pairs(frames: DataFrame, keys: list[str], pos: str, k: int, carry: list[str]) -> DataFrame:
    """Frame pairs (a, b) with 1 <= b.pos - a.pos <= k: an equi-join on the exploded offset."""
    a = frames.select(*keys, F.col(pos).alias("a_pos"), *[F.col(c).alias(f"a_{c}") for c in carry])
    b = frames.select(*keys, F.col(pos).alias("b_pos"), *[F.col(c).alias(f"b_{c}") for c in carry])
    ahead = a.withColumn("b_pos", F.explode(F.sequence(F.col("a_pos") + 1, F.col("a_pos") + k)))
    return ahead.join(b, [*keys, "b_pos"])


def rig_pairs(image_frames: DataFrame, same_frame: bool, k: int | None = None) -> DataFrame:
    """Image pairs of one rig frame, or of frames at most ``k`` apart."""
    if same_frame:
        p = self_pairs(image_frames, ["rig_id", "frame_id"], "image_id")
        return p.select("rig_id", F.col("a_image_id").alias("i"), F.col("b_image_id").alias("j"))
    p = band_pairs(image_frames, ["rig_id"], "frame_id", k or 1, ["image_id"])
    return p.select("rig_id", F.least("a_image_id", "b_image_id").alias("i"), F.greatest("a_image_id", "b_image_id").alias("j"))


def reach_fraction(pairs: DataFrame, images: DataFrame, subset: DataFrame, min_shared: int) -> DataFrame:
    """One row (reached, total, fraction): images that are in ``subset`` or share at least
    ``min_shared`` with one of its members, among all images. An empty subset reaches none."""
    strong = pairs.filter(F.col("shared") >= min_shared)
    links = strong.select(F.col("i").alias("member"), F.col("j").alias("image_id")).unionAll(strong.select("j", "i"))
    member = subset.select("image_id").distinct()
    near = links.join(member.withColumnRenamed("image_id", "member"), "member", "left_semi").select("image_id")
    hit = member.unionAll(near).distinct().withColumn("hit", F.lit(1))
    out = images.select("image_id").distinct().join(hit, "image_id", "left").agg(
        F.count("hit").alias("reached"), F.count(F.lit(1)).alias("total")
    )
    return out.withColumn("fraction", F.when(F.col("total") > 0, F.col("reached") / F.col("total")).otherwise(0.0))


#: Pairs of a connected part of the graph that one task walks through by itself.
LOCAL_PAIRS = 200_000


def seed_groups(pairs: DataFrame, group_size: int = 5, min_shared: int = 8) -> DataFrame:
    """Mutually covisible groups, strongest pair first, images used once: (group_no, image_id).

    A group starts from the strongest pair left (ties to the smaller ids) and takes, one by
    one, the image that shares most with its weakest partner among those linked to all
    members. Connected parts of the graph don't affect each other: parts of bounded size are
    walked through in one task each. In larger parts a round settles every pair that is the
    strongest of all pairs at most two images away, which is what the walk would reach with
    that neighbourhood unchanged; used images leave and parts fall apart.
    """
    live = cut(pairs.filter(F.col("shared") >= min_shared).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("shared").cast("long").alias("shared")))
    done = []
    while not live.isEmpty():
        parts = live.join(connected_components(live, "i", "j").withColumnRenamed("node", "i"), "i")
        size = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        parts = cut(parts.join(size, "root"))
        small = parts.filter(F.col("n") <= LOCAL_PAIRS).select("root", "i", "j", "shared")
        done.append(small.groupBy("root").applyInPandas(_walk(group_size), "i long, j long, shared long, image_id long"))
        large = parts.filter(F.col("n") > LOCAL_PAIRS).select("i", "j", "shared")
        if large.isEmpty():
            break
        won = cut(_settled_groups(large, group_size))
        done.append(won)
        used = won.select("image_id").distinct()
        live = cut(large.join(used.withColumnRenamed("image_id", "i"), "i", "left_anti").join(used.withColumnRenamed("image_id", "j"), "j", "left_anti"))
    if not done:
        return pairs.sparkSession.createDataFrame([], "group_no long, image_id long")
    members = cut(reduce(DataFrame.unionByName, done))
    seeds = global_rank(members.select((-F.col("shared")).alias("s"), "i", "j").distinct(), ["s", "i", "j"], out="group_no")
    return members.join(seeds.select("i", "j", "group_no"), ["i", "j"]).select("group_no", "image_id")


def _walk(group_size: int):
    """The greedy walk over one connected part."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, int]] = defaultdict(dict)
        for i, j, s in zip(part["i"].tolist(), part["j"].tolist(), part["shared"].tolist(), strict=True):
            near[i][j] = near[j][i] = s
        used, out = set(), []
        for i, j, s in part.sort_values(["shared", "i", "j"], ascending=[False, True, True])[["i", "j", "shared"]].itertuples(index=False):
            if i in used or j in used:
                continue
            group = [i, j]
            while len(group) < group_size:
                both = set(near[group[0]]).intersection(*(near[g] for g in group[1:])) - used
                if not both:
                    break
                group.append(max(both, key=lambda k: (min(near[k][g] for g in group), -k)))
            used.update(group)
            out += [(i, j, s, g) for g in group]
        return pd.DataFrame(out, columns=["i", "j", "shared", "image_id"], dtype="int64")

    return run


def _settled_groups(live: DataFrame, group_size: int) -> DataFrame:
    """Groups of the pairs that no stronger pair within two images can disturb."""
    key = F.struct((-F.col("shared")).alias("s"), F.col("i").alias("a"), F.col("j").alias("b"))
    keyed = live.withColumn("key", key)
    sym = cut(keyed.select(F.col("i").alias("x"), F.col("j").alias("y"), "shared", "key").unionByName(keyed.select(F.col("j").alias("x"), F.col("i").alias("y"), "shared", "key")))
    best = sym.groupBy("x").agg(F.min("key").alias("k"))
    for _ in range(2):
        around = sym.select("x", "y").join(best.withColumnRenamed("x", "y"), "y").select("x", "k")
        best = around.unionByName(best).groupBy("x").agg(F.min("k").alias("k"))
    at_i, at_j = best.select(F.col("x").alias("i"), F.col("k").alias("ki")), best.select(F.col("x").alias("j"), F.col("k").alias("kj"))
    won = keyed.join(at_i, "i").join(at_j, "j").filter((F.col("key") == F.col("ki")) & (F.col("key") == F.col("kj"))).select("i", "j", "shared")
    members = cut(won.select("i", "j", "shared", F.explode(F.array("i", "j")).alias("image_id")))
    for size in range(2, group_size):
        seeds = ["i", "j"]
        met = sym.select("x", "y", F.col("shared").alias("link")).join(members.withColumnRenamed("image_id", "x"), "x")
        inside = members.select("i", "j", F.col("image_id").alias("y"))
        full = met.join(inside, [*seeds, "y"], "left_anti").groupBy(*seeds, "shared", "y").agg(F.count(F.lit(1)).alias("n"), F.min("link").alias("weakest")).filter(F.col("n") == size)
        best_y = full.groupBy(*seeds, "shared").agg(F.min(F.struct((-F.col("weakest")).alias("w"), "y")).alias("b"))
        members = cut(members.unionByName(best_y.select("i", "j", "shared", F.col("b.y").alias("image_id"))))
    return members


def thin(pairs: DataFrame, order: DataFrame, tau: float) -> DataFrame:
    """Redundancy thinning: keep an image when its best count against kept earlier images is in [tau/8, tau).

    ``order`` is (image_id, rank). An image is decided once no undecided earlier
    partner can change the answer, so each round settles many images at once. The
    first image is always kept; images without any kept partner are dropped.
    """
    low, high = tau / 8.0, tau
    r1 = order.select(F.col("image_id").alias("i"), F.col("rank").alias("ri"))
    r2 = order.select(F.col("image_id").alias("j"), F.col("rank").alias("rj"))
    e = pairs.select("i", "j", "shared").filter(F.col("shared") >= low).join(r1, "i").join(r2, "j")
    later = F.col("ri") > F.col("rj")
    # (image, earlier partner, count)
    deps = cut(
        e.select(
            F.when(later, F.col("i")).otherwise(F.col("j")).alias("image_id"),
            F.when(later, F.col("j")).otherwise(F.col("i")).alias("earlier"),
            "shared",
        )
    )
    first = order.agg(F.min_by("image_id", "rank").alias("image_id"))
    state = order.select("image_id").join(first.withColumn("kept", F.lit(True)), "image_id", "left")
    # Without an earlier partner at or above the band's floor the answer is already no.
    has_dep = deps.select("image_id").distinct().withColumn("dep", F.lit(True))
    state = cut(
        state.join(has_dep, "image_id", "left").select(
            "image_id", F.when(F.col("kept").isNull() & F.col("dep").isNull(), F.lit(False)).otherwise(F.col("kept")).alias("kept")
        )
    )
    while state.filter(F.col("kept").isNull()).limit(1).count():
        seen = state.select(F.col("image_id").alias("earlier"), F.col("kept").alias("e_kept"))
        facts = deps.join(seen, "earlier").groupBy("image_id").agg(
            F.max(F.when(F.col("e_kept"), F.col("shared"))).alias("best"),
            F.sum(F.col("e_kept").isNull().cast("int")).alias("open"),
            F.sum((F.col("e_kept").isNull() & (F.col("shared") >= high)).cast("int")).alias("open_high"),
        )
        # Undecided partners below the band's top cannot push a kept image out of it.
        decided = (
            F.when(F.col("best") >= high, F.lit(False))
            .when(F.col("best").isNotNull() & (F.col("open_high") == 0), F.lit(True))
            .when(F.col("open") == 0, F.lit(False))
        )
        state = cut(
            state.join(facts, "image_id", "left").select("image_id", F.coalesce("kept", decided).alias("kept"))
        )
    return state.filter("kept").select("image_id")


def isolation_order(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Sweep order for thinning: largest distance to the nearest covisible image first."""
    both = pairs.select(F.col("i").alias("image_id"), "mean_disp").unionAll(pairs.select("j", "mean_disp"))
    iso = both.groupBy("image_id").agg(F.min("mean_disp").alias("isolation"))
    return images.select("image_id").join(iso, "image_id", "left").withColumn(
        "isolation", F.coalesce("isolation", F.lit(float("inf")))
    )


def thin_to(pairs: DataFrame, order: DataFrame, target: int, iterations: int = 25) -> DataFrame:
    """Bisect the thinning threshold for a subset of about ``target`` images."""
    from .skew import exact_median

    both = pairs.select(F.col("i").alias("image_id"), "shared").unionAll(pairs.select("j", "shared"))
    peaks = order.select("image_id").join(both, "image_id", "left").groupBy("image_id").agg(
        F.coalesce(F.max("shared"), F.lit(0)).alias("peak")
    )
    med = exact_median(peaks, [], "peak", "m").first()["m"]
    lo, hi, best, best_gap = 1.0, float(med), None, None
    for _ in range(iterations):
        mid = (lo + hi) / 2.0
        kept = thin(pairs, order, mid)
        n = kept.count()
        gap = abs(n - target)
        if best is None or gap < best_gap:
            best, best_gap = kept, gap
        if gap == 0 or hi - lo < 1e-6:
            break
        lo, hi = (mid, hi) if n < target else (lo, mid)
    return best
