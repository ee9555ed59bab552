"""Ordered-sequence analytics: windows over frames cut into overlapping chunks.

Frames are (seq, pos, ...) with dense ``pos``. Every window below looks a fixed
number of frames back and ahead, so sequences are cut into chunks with halos and
one long sequence runs in many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quat as Q
from ..functions import vec as V
from .skew import exact_median, halo_chunks

# Thresholds and window lengths of the discontinuity signals.
STEP_RATIO_THRESHOLD = 1.5
OVERLAP_DROP_THRESHOLD = 1.8
OBS_Z_THRESHOLD = 2.5
STEP_RATIO_WINDOW = 8
OVERLAP_WINDOW = 16
OVERLAP_BASELINE_WINDOW = 24
OBS_WINDOW = 24
POSE_TRANS_FACTOR = 3.0
POSE_ROT_DEG = 15.0
JUMP_SIGMA = 2.5
MAD_SCALE = 1.4826

POSE = ("cx", "cy", "cz", "qw", "qx", "qy", "qz")


def _chunk_window() -> Window:
    return Window.partitionBy("seq", "_chunk").orderBy("pos")


def steps(frames: DataFrame) -> DataFrame:
    """Per edge (pos, pos + 1): translation step, rotation step in degrees; ``pos`` is the edge index."""
    h = halo_chunks(frames.select("seq", "pos", *POSE), "pos", 0, 1)
    w = _chunk_window()
    nxt = {c: F.lead(c).over(w) for c in POSE}
    h = h.select("*", *[e.alias(f"n_{c}") for c, e in nxt.items()]).filter(F.col("_own") & F.col("n_cx").isNotNull())
    d = V.sub(V.vec("n_cx", "n_cy", "n_cz"), V.vec("cx", "cy", "cz"))
    rot = Q.angle_between(Q.quat("qw", "qx", "qy", "qz"), Q.quat("n_qw", "n_qx", "n_qy", "n_qz"))
    return h.select("seq", "pos", V.norm(d).alias("step"), F.degrees(rot).alias("rot_deg"))


def motion_path(frames: DataFrame) -> DataFrame:
    """Steps with jump flags: above mean + 2.5 population sigmas of the sequence."""
    s = steps(frames)
    t = s.groupBy("seq").agg(
        (F.avg("step") + JUMP_SIGMA * F.stddev_pop("step")).alias("t_lim"),
        (F.avg("rot_deg") + JUMP_SIGMA * F.stddev_pop("rot_deg")).alias("r_lim"),
    )
    return s.join(t, "seq").select(
        "seq", "pos", "step", "rot_deg",
        (F.col("step") > F.col("t_lim")).alias("trans_flag"), (F.col("rot_deg") > F.col("r_lim")).alias("rot_flag"),
    )


def interpolation_residuals(frames: DataFrame) -> DataFrame:
    """Distance of each inner frame from the pose halfway between its neighbours."""
    h = halo_chunks(frames.select("seq", "pos", *POSE), "pos", 1, 1)
    w = _chunk_window()
    h = h.select(
        "*", *[F.lag(c).over(w).alias(f"p_{c}") for c in POSE], *[F.lead(c).over(w).alias(f"n_{c}") for c in POSE]
    ).filter(F.col("_own") & F.col("p_cx").isNotNull() & F.col("n_cx").isNotNull())
    mid = V.scale(V.add(V.vec("p_cx", "p_cy", "p_cz"), V.vec("n_cx", "n_cy", "n_cz")), F.lit(0.5))
    q_mid = Q.halfway(Q.quat("p_qw", "p_qx", "p_qy", "p_qz"), Q.quat("n_qw", "n_qx", "n_qy", "n_qz"))
    rot = Q.angle_between(q_mid, Q.quat("qw", "qx", "qy", "qz"))
    return h.select(
        "seq", "pos", V.norm(V.sub(V.vec("cx", "cy", "cz"), mid)).alias("trans_diff"), F.degrees(rot).alias("rot_diff")
    )


def _lagrange(times: list[Column], target: Column) -> list[Column]:
    """Weights of the polynomial through ``times`` evaluated at ``target``."""
    out = []
    for i, ti in enumerate(times):
        w = F.lit(1.0)
        for j, tj in enumerate(times):
            if j != i:
                w = w * ((target - tj) / (ti - tj))
        out.append(w)
    return out


def extrapolation_errors(frames: DataFrame, number: str = "frame_no") -> DataFrame:
    """Pose prediction error from each side: the smaller of the 2-point and 3-point fits.

    ``frames`` carries the frame number the fits use as time. NULL where a side
    has fewer than two frames.
    """
    cols = [*POSE, number]
    h = halo_chunks(frames.select("seq", "pos", *cols), "pos", 3, 3)
    w = _chunk_window()
    named = []
    for k in (1, 2, 3):
        named += [F.lag(c, k).over(w).alias(f"l{k}_{c}") for c in cols]
        named += [F.lead(c, k).over(w).alias(f"r{k}_{c}") for c in cols]
    h = h.select("*", *named).filter("_own")

    # Each stage lands in named columns, so no expression is expanded inside another.
    fits = {"ll": ["l2", "l1"], "lq": ["l3", "l2", "l1"], "rl": ["r1", "r2"], "rq": ["r1", "r2", "r3"]}
    target = F.col(number).cast("double")
    weights, flips, sums, diffs, angles = {}, {}, {}, {}, {}
    for f, order in fits.items():
        times = [F.col(f"{s}_{number}").cast("double") for s in order]
        # Order inside a fit is by time, which fixes the hemisphere reference.
        first = Q.quat(*[f"{order[0]}_{c}" for c in POSE[3:]])
        for s, wt in zip(order, _lagrange(times, target)):
            weights[f"w_{f}_{s}"] = wt
            other = Q.quat(*[f"{s}_{c}" for c in POSE[3:]])
            flips[f"s_{f}_{s}"] = F.when(Q.dot4(first, other) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        for c in POSE:
            terms = [F.col(f"w_{f}_{s}") * F.col(f"{s}_{c}") * (F.lit(1.0) if c[0] == "c" else F.col(f"s_{f}_{s}")) for s in order]
            sums[f"p_{f}_{c}"] = reduce(lambda x, y: x + y, terms)
        turn = Q.mul(Q.quat(*POSE[3:]), Q.conj(Q.quat(*[f"p_{f}_{c}" for c in POSE[3:]])))
        for c, e in zip("wxyz", turn):
            diffs[f"d_{f}_{c}"] = e
        angles[f"t_{f}"] = V.norm(V.sub(V.vec(*[f"p_{f}_{c}" for c in POSE[:3]]), V.vec(*POSE[:3])))
        # The angle of an unnormalised quaternion is that of the normalised one.
        angles[f"r_{f}"] = F.degrees(Q.angle(Q.quat(*[f"d_{f}_{c}" for c in "wxyz"])))
    for stage in ({**weights, **flips}, sums, diffs, angles):
        h = h.withColumns(stage)
    outs = []
    for side, near2, near3, lin, quad in (("left", "l2", "l3", "ll", "lq"), ("right", "r2", "r3", "rl", "rq")):
        has2, has3 = F.col(f"{near2}_cx").isNotNull(), F.col(f"{near3}_cx").isNotNull()
        for kind, name in (("t", "trans"), ("r", "rot")):
            one, two = F.col(f"{kind}_{lin}"), F.col(f"{kind}_{quad}")
            outs.append(F.when(has2, F.when(has3, F.least(one, two)).otherwise(one)).alias(f"{side}_{name}_err"))
    return h.select("seq", "pos", *outs)


def _framed_values(df: DataFrame, value: str, before: int, after: int, skip_self: bool = True) -> DataFrame:
    """Adds sorted arrays ``pre`` and ``post`` of the neighbouring values of each row."""
    h = halo_chunks(df, "pos", before, after)
    w = _chunk_window()
    pre = F.collect_list(value).over(w.rowsBetween(-before, -1 if skip_self else 0))
    post = F.collect_list(value).over(w.rowsBetween(1, after))
    return h.withColumn("pre", F.sort_array(pre)).withColumn("post", F.sort_array(post)).filter("_own").drop("_chunk", "_own")


def step_ratios(edges: DataFrame, window: int = STEP_RATIO_WINDOW) -> DataFrame:
    """Ratio of the median step before an edge to the one after it, the edge itself left out."""
    f = _framed_values(edges.select("seq", "pos", "step"), "step", window - 1, window - 1)
    pre, post = V.sorted_median(F.col("pre")), V.sorted_median(F.col("post"))
    enough = (F.size("pre") >= 2) & (F.size("post") >= 2) & (pre > 0) & (post > 0)
    return f.select("seq", "pos", F.when(enough, F.greatest(pre / post, post / pre)).alias("step_ratio"))


def obs_z_scores(counts: DataFrame, window: int = OBS_WINDOW) -> DataFrame:
    """Robust z of each frame's observation count against its neighbours (median, MAD)."""
    half = window // 2
    f = _framed_values(counts.select("seq", "pos", "n_obs"), "n_obs", half, half)
    f = f.withColumn("near", F.sort_array(F.concat("pre", "post"))).drop("pre", "post")
    f = f.withColumn("med", V.sorted_median(F.col("near")))
    f = f.withColumn("mad", V.sorted_median(F.sort_array(F.transform("near", lambda v: F.abs(v - F.col("med"))))))
    ok = (F.size("near") >= 5) & (F.col("mad") > 0)
    return f.select("seq", "pos", F.when(ok, (F.col("n_obs") - F.col("med")) / (MAD_SCALE * F.col("mad"))).alias("obs_z"))


def edge_overlaps(seen: DataFrame, sequence_lengths: DataFrame, window: int = OVERLAP_WINDOW) -> DataFrame:
    """Share of points crossing each edge, by windows of ``window`` frames on both sides.

    ``seen`` is (seq, pos, point). A point counts for an edge when one of its
    frames lies within the window before it (after it, or both); gaps between
    consecutive sightings make those edge ranges disjoint, so plain counts suffice.
    """
    s = seen.select("seq", "pos", "point").distinct()
    h = halo_chunks(s, "pos", 2 * window, 2 * window)
    w = Window.partitionBy("seq", "point", "_chunk").orderBy("pos")
    h = h.withColumn("prev", F.lag("pos").over(w)).withColumn("next", F.lead("pos").over(w)).filter("_own")
    last = sequence_lengths.select("seq", (F.col("n") - 2).alias("last_edge"), "n")
    h = h.join(last, "seq").filter(F.col("n") >= 3 * window)
    far = F.lit(2**62)
    pre_hi = F.least(F.col("pos") + window - 1, F.coalesce("next", far) - 1, F.col("last_edge"))
    post_lo = F.greatest(F.col("pos") - window, F.coalesce("prev", F.lit(0)), F.lit(0))
    cross_lo = F.greatest(F.col("pos"), F.coalesce("next", far) - window)
    cross_hi = F.least(F.coalesce("next", F.lit(-1)) - 1, F.col("pos") + window - 1)
    def spread(lo, hi, kind):
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("edge")))).otherwise(
            F.array().cast("array<struct<kind:string,edge:bigint>>")
        )

    parts = F.concat(
        spread(F.col("pos"), pre_hi, "pre"),
        spread(post_lo, F.least(F.col("pos") - 1, F.col("last_edge")), "post"),
        spread(cross_lo, F.least(cross_hi, F.col("last_edge")), "cross"),
    )
    hits = h.select("seq", F.explode(parts).alias("e"))
    one = lambda k: F.sum((F.col("e.kind") == k).cast("long"))
    counts = hits.groupBy("seq", F.col("e.edge").alias("pos")).agg(one("pre").alias("pre"), one("post").alias("post"), one("cross").alias("cross"))
    ok = (F.col("pre") > 0) & (F.col("post") > 0)
    return counts.filter(ok).select("seq", "pos", (F.col("cross") / F.least("pre", "post")).alias("overlap"))


def overlap_drops(overlaps: DataFrame, baseline: int = OVERLAP_BASELINE_WINDOW) -> DataFrame:
    """Local median overlap over an edge's own overlap; infinite when nothing crosses."""
    f = _framed_values_by_range(overlaps, "overlap", baseline)
    f = f.withColumn("base", V.sorted_median(F.col("near")))
    drop = (
        F.when(F.size("near") < 3, F.lit(None)).when(F.col("overlap") == 0, F.lit(float("inf")))
        .when(F.col("base") <= 0, F.lit(None)).otherwise(F.col("base") / F.col("overlap"))
    )
    return f.select("seq", "pos", "overlap", drop.cast("double").alias("drop"))


def _framed_values_by_range(df: DataFrame, value: str, reach: int) -> DataFrame:
    """Adds the sorted array ``near`` of values at most ``reach`` positions away, own row left out."""
    h = halo_chunks(df, "pos", reach, reach)
    w = _chunk_window()
    near = F.concat(
        F.collect_list(value).over(w.rangeBetween(-reach, -1)), F.collect_list(value).over(w.rangeBetween(1, reach))
    )
    return h.withColumn("near", F.sort_array(near)).filter("_own").drop("_chunk", "_own")


def frame_flags(signals: DataFrame) -> DataFrame:
    """Flag names per frame.

    ``signals``: seq, pos, left/right_trans_err, left/right_rot_err, step_ratio and
    drop of the landing edge, obs_z, trans_limit.
    """
    tests = [
        (F.col("left_trans_err") > F.col("trans_limit"), "L.t"),
        (F.col("left_rot_err") > POSE_ROT_DEG, "L.r"),
        (F.col("right_trans_err") > F.col("trans_limit"), "R.t"),
        (F.col("right_rot_err") > POSE_ROT_DEG, "R.r"),
        (F.col("step_ratio") > STEP_RATIO_THRESHOLD, "Step"),
        (F.col("drop") > OVERLAP_DROP_THRESHOLD, "Cov"),
        (F.col("obs_z") < -OBS_Z_THRESHOLD, "Obs"),
    ]
    return signals.withColumn("flags", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests])))


def discontinuity_signals(frames: DataFrame, seen: DataFrame) -> DataFrame:
    """All signals of a pose sequence joined per frame, with flags."""
    s = steps(frames)
    limit = exact_median(s, ["seq"], "step", "m").select("seq", (F.col("m") * POSE_TRANS_FACTOR).alias("trans_limit"))
    counts = frames.select("seq", "pos").join(
        seen.select("seq", "pos", "point").distinct().groupBy("seq", "pos").agg(F.count(F.lit(1)).alias("n_obs")),
        ["seq", "pos"], "left",
    ).withColumn("n_obs", F.coalesce("n_obs", F.lit(0)).cast("double"))
    lengths = frames.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    landing = (F.col("pos") + 1).alias("pos")
    ratios = step_ratios(s).select("seq", landing, "step_ratio")
    drops = overlap_drops(edge_overlaps(seen, lengths)).select("seq", landing, "drop")
    j = (
        extrapolation_errors(frames)
        .join(ratios, ["seq", "pos"], "left").join(drops, ["seq", "pos"], "left")
        .join(obs_z_scores(counts), ["seq", "pos"], "left").join(limit, "seq", "left")
    )
    return frame_flags(j)


def flagged_edges(flags: DataFrame, lengths: DataFrame) -> DataFrame:
    """Evidence per edge: (seq, edge, evidence). Obs only adds to edges flagged otherwise."""
    f = flags.select("seq", "pos", F.explode("flags").alias("flag")).join(lengths.select("seq", "n"), "seq")
    direct = f.filter("flag <> 'Obs'").withColumn(
        "edge", F.when(F.col("flag").startswith("R"), F.col("pos")).otherwise(F.col("pos") - 1)
    ).filter((F.col("edge") >= 0) & (F.col("edge") < F.col("n") - 1))
    base = direct.groupBy("seq", "edge").agg(F.count(F.lit(1)).alias("evidence"))
    dim = f.filter("flag = 'Obs'").select("seq", F.explode(F.array(F.col("pos") - 1, F.col("pos"))).alias("edge"))
    extra = dim.groupBy("seq", "edge").agg(F.count(F.lit(1)).alias("extra"))
    return base.join(extra, ["seq", "edge"], "left").select(
        "seq", "edge", (F.col("evidence") + F.coalesce("extra", F.lit(0))).alias("evidence")
    )


def core_edges(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """One edge per run of touching edges: most evidence, then fewest shared points, then first.

    ``shared`` is (seq, edge, shared). Runs are found by rank differences, so a
    long sequence is ranked over range partitions, not in one window.
    """
    from .skew import global_rank

    ranked = global_rank(edges, ["edge"], ["seq"], "r").withColumn("run", F.col("edge") - F.col("r"))
    j = ranked.join(shared, ["seq", "edge"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    order = F.struct(F.col("evidence"), -F.col("shared"), -F.col("edge"))
    return j.groupBy("seq", "run").agg(F.max_by(F.struct("edge", "evidence", "shared"), order).alias("b")).select(
        "seq", "b.edge", "b.evidence", "b.shared"
    )


def segments(breaks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Frame ranges between break edges: (seq, segment, first_pos, last_pos)."""
    from .skew import global_rank

    ends = breaks.select("seq", F.col("edge").alias("last_pos")).unionByName(
        lengths.select("seq", (F.col("n") - 1).alias("last_pos"))
    ).distinct()
    r = global_rank(ends, ["last_pos"], ["seq"], "segment")
    prev = r.select("seq", (F.col("segment") + 1).alias("segment"), (F.col("last_pos") + 1).alias("first_pos"))
    return r.join(prev, ["seq", "segment"], "left").select(
        "seq", "segment", F.coalesce("first_pos", F.lit(0)).alias("first_pos"), "last_pos"
    )


def sequence_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per frame row, keyed by sequence and position."""
    return rows.select("seq", "pos", F.to_json(F.struct(*columns)).alias("json"))
