"""Sequence analytics on the events table: user = sequence, event order = frame order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quat as Q
from ..operators import motion
from ..session import cut
from . import roles
from .registry import query, r6

# Each event is a camera pose along its user's path.
TRACK_SQL = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kk FROM frames),
raw AS (SELECT seq, pos, event_id, event_type, kk, CAST(pos * 2 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS frame_no,
               pos * 0.5 + value / 100.0 AS cx, sin(pos / 7.0) * 3.0 AS cy, kk / 50.0 AS cz,
               1.0 AS aw, 0.2 * sin(pos / 5.0) AS ax, 0.1 * cos(pos / 3.0) + value / 2000.0 AS ay, kk / 400.0 AS az FROM k),
path AS (SELECT *, aw / n AS qw, ax / n AS qx, ay / n AS qy, az / n AS qz
         FROM (SELECT *, sqrt(aw * aw + ax * ax + ay * ay + az * az) AS n FROM raw))
"""
PATH = (roles.FRAMES_SQL, TRACK_SQL)

STEPS_SQL = """
nx AS (SELECT *, lead(cx) OVER w AS ncx, lead(cy) OVER w AS ncy, lead(cz) OVER w AS ncz, lead(qw) OVER w AS nqw, lead(qx) OVER w AS nqx,
              lead(qy) OVER w AS nqy, lead(qz) OVER w AS nqz FROM path WINDOW w AS (PARTITION BY seq ORDER BY pos)),
steps AS (SELECT seq, pos, sqrt((ncx - cx) * (ncx - cx) + (ncy - cy) * (ncy - cy) + (ncz - cz) * (ncz - cz)) AS step,
                 degrees(2 * acos(least(1.0, abs(qw * nqw + qx * nqx + qy * nqy + qz * nqz)))) AS rot_deg FROM nx WHERE ncx IS NOT NULL)
"""


def path(spark, sf):
    f = roles.frames(spark, sf)
    k = F.get_json_object("props", "$.k").cast("long")
    pos, value = F.col("pos"), F.col("value")
    q = Q.normalize((F.lit(1.0), 0.2 * F.sin(pos / 5.0), 0.1 * F.cos(pos / 3.0) + value / 2000.0, k / 400.0))
    return cut(
        f.select(
            "seq", "pos", "event_id", "event_type", k.alias("kk"),
            (pos * 2 + F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("frame_no"),
            (pos * 0.5 + value / 100.0).alias("cx"), (F.sin(pos / 7.0) * 3.0).alias("cy"), (k / 50.0).alias("cz"),
            *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"))],
        )
    )


def seen(frames):
    """Two tracks per frame: the k bucket and the event type with its decade."""
    points = F.array(F.concat(F.lit("k"), F.expr("kk div 4").cast("string")), F.concat("event_type", F.expr("kk div 20").cast("string")))
    return frames.select("seq", "pos", F.explode(points).alias("point"))


SEEN_SQL = """
seen AS (SELECT DISTINCT seq, pos, unnest(['k' || (kk // 4), event_type || (kk // 20)]) AS point FROM k)
"""


@query(
    "motion_path",
    roles.sql(
        *PATH, STEPS_SQL,
        body="""
        , t AS (SELECT seq, avg(step) + 2.5 * stddev_pop(step) AS tl, avg(rot_deg) + 2.5 * stddev_pop(rot_deg) AS rl FROM steps GROUP BY 1)
        SELECT seq, pos, round(step, 5) AS step, round(rot_deg, 4) AS rot_deg, step > tl AS trans_flag, rot_deg > rl AS rot_flag FROM steps JOIN t USING (seq)
        """,
    ),
)
def motion_path(spark, sf):
    m = motion.motion_path(path(spark, sf))
    return m.select("seq", "pos", r6("step", "step", 5), r6("rot_deg", "rot_deg", 4), "trans_flag", "rot_flag")


@query(
    "interpolation_residuals",
    roles.sql(
        *PATH,
        body="""
        , n AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(cz) OVER w AS pz, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny, lead(cz) OVER w AS nz,
                       lag(qw) OVER w + lead(qw) OVER w AS hw, lag(qx) OVER w + lead(qx) OVER w AS hx, lag(qy) OVER w + lead(qy) OVER w AS hy, lag(qz) OVER w + lead(qz) OVER w AS hz
                FROM path WINDOW w AS (PARTITION BY seq ORDER BY pos))
        SELECT seq, pos, round(sqrt((cx - (px + nx) / 2) * (cx - (px + nx) / 2) + (cy - (py + ny) / 2) * (cy - (py + ny) / 2) + (cz - (pz + nz) / 2) * (cz - (pz + nz) / 2)), 5) AS trans_diff,
               round(degrees(2 * acos(least(1.0, abs(qw * hw + qx * hx + qy * hy + qz * hz) / sqrt(hw * hw + hx * hx + hy * hy + hz * hz)))), 4) AS rot_diff
        FROM n WHERE px IS NOT NULL AND nx IS NOT NULL
        """,
    ),
)
def interpolation_residuals(spark, sf):
    r = motion.interpolation_residuals(path(spark, sf))
    return r.select("seq", "pos", r6("trans_diff", "trans_diff", 5), r6("rot_diff", "rot_diff", 4))


def _fit_sql(side: str) -> str:
    """Prediction errors of the 2- and 3-frame fits from one side."""
    o = {"left": ("lag", [2, 1], [3, 2, 1]), "right": ("lead", [1, 2], [1, 2, 3])}[side]
    fn, lin, quad = o
    cols = ["frame_no", "cx", "cy", "cz", "qw", "qx", "qy", "qz"]
    names = ", ".join(f"{fn}({c}, {k}) OVER w AS {c}{k}" for k in (1, 2, 3) for c in cols)

    def weights(ks):
        out = {}
        for i in ks:
            out[i] = " * ".join(f"((frame_no - frame_no{j})::DOUBLE / (frame_no{i} - frame_no{j}))" for j in ks if j != i)
        return out

    def pred(ks, tag):
        w = weights(ks)
        lines = [f"{w[i]} AS w{tag}{i}" for i in ks]
        return ", ".join(lines)

    def flip(ks, i):
        a = ks[0]
        if i == a:
            return "1.0"
        return f"(CASE WHEN qw{a} * qw{i} + qx{a} * qx{i} + qy{a} * qy{i} + qz{a} * qz{i} < 0 THEN -1.0 ELSE 1.0 END)"

    def center(ks, tag):
        d = [f"({' + '.join(f'w{tag}{i} * {c}{i}' for i in ks)} - {c})" for c in ("cx", "cy", "cz")]
        return "sqrt(" + " + ".join(f"{x} * {x}" for x in d) + ")"

    def rot(ks, tag):
        comp = {c: "(" + " + ".join(f"w{tag}{i} * {flip(ks, i)} * {c}{i}" for i in ks) + ")" for c in ("qw", "qx", "qy", "qz")}
        dot = " + ".join(f"{comp[c]} * {c}" for c in comp)
        n2 = " + ".join(f"{comp[c]} * {comp[c]}" for c in comp)
        return f"degrees(2 * acos(least(1.0, abs({dot}) / sqrt({n2}))))"

    far, near2 = (3, 2)
    return f"""
    n_{side} AS (SELECT *, {names} FROM path WINDOW w AS (PARTITION BY seq ORDER BY pos)),
    w_{side} AS (SELECT *, {pred(lin, 'l')}, {pred(quad, 'q')} FROM n_{side}),
    e_{side} AS (SELECT seq, pos,
        CASE WHEN cx{near2} IS NOT NULL THEN CASE WHEN cx{far} IS NOT NULL THEN least({center(lin, 'l')}, {center(quad, 'q')}) ELSE {center(lin, 'l')} END END AS te,
        CASE WHEN cx{near2} IS NOT NULL THEN CASE WHEN cx{far} IS NOT NULL THEN least({rot(lin, 'l')}, {rot(quad, 'q')}) ELSE {rot(lin, 'l')} END END AS re
        FROM w_{side})
    """


@query(
    "extrapolation_errors",
    roles.sql(
        *PATH, _fit_sql("left"), _fit_sql("right"),
        body="""SELECT l.seq, l.pos, round(l.te, 4) AS left_trans_err, round(l.re, 3) AS left_rot_err, round(r.te, 4) AS right_trans_err, round(r.re, 3) AS right_rot_err
                FROM e_left l JOIN e_right r USING (seq, pos)""",
    ),
)
def extrapolation_errors(spark, sf):
    e = motion.extrapolation_errors(path(spark, sf))
    return e.select(
        "seq", "pos", r6("left_trans_err", "left_trans_err", 4), r6("left_rot_err", "left_rot_err", 3),
        r6("right_trans_err", "right_trans_err", 4), r6("right_rot_err", "right_rot_err", 3),
    )


RATIO_SQL = """
ratio AS (
  SELECT seq, pos, CASE WHEN np >= 2 AND nq >= 2 AND mp > 0 AND mq > 0 THEN greatest(mp / mq, mq / mp) END AS step_ratio FROM (
    SELECT seq, pos, median(step) OVER p AS mp, count(*) OVER p AS np, median(step) OVER q AS mq, count(*) OVER q AS nq FROM steps
    WINDOW p AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)))
"""


@query("step_ratio", roles.sql(*PATH, STEPS_SQL, RATIO_SQL, body="SELECT seq, pos, round(step_ratio, 5) AS step_ratio FROM ratio"))
def step_ratio(spark, sf):
    s = motion.steps(path(spark, sf))
    return motion.step_ratios(s).select("seq", "pos", r6("step_ratio", "step_ratio", 5))


Z_SQL = """
cnt AS (SELECT p.seq, p.pos, CAST(count(s.point) + p.kk % 7 AS DOUBLE) AS n_obs FROM path p LEFT JOIN seen s ON s.seq = p.seq AND s.pos = p.pos GROUP BY p.seq, p.pos, p.kk),
near AS (SELECT a.seq, a.pos, a.n_obs, list(b.n_obs) AS v FROM cnt a JOIN cnt b ON a.seq = b.seq AND b.pos <> a.pos AND abs(a.pos - b.pos) <= 12 GROUP BY 1, 2, 3),
mm AS (SELECT *, list_median(v) AS med FROM near),
zz AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - med))) AS mad FROM mm)
"""


@query(
    "obs_robust_z",
    roles.sql(
        *PATH, SEEN_SQL, Z_SQL,
        body="SELECT seq, pos, round(CASE WHEN len(v) >= 5 AND mad > 0 THEN (n_obs - med) / (1.4826 * mad) END, 5) AS obs_z FROM zz",
    ),
)
def obs_robust_z(spark, sf):
    f = path(spark, sf)
    n = seen(f).distinct().groupBy("seq", "pos").agg(F.count(F.lit(1)).alias("c"))
    counts = f.join(n, ["seq", "pos"]).select("seq", "pos", (F.col("c") + F.col("kk") % 7).cast("double").alias("n_obs"))
    return motion.obs_z_scores(counts).select("seq", "pos", r6("obs_z", "obs_z", 5))


OVERLAP_SQL = """
len_of AS (SELECT seq, count(*) AS frames FROM path GROUP BY 1),
edges AS (SELECT p.seq, p.pos FROM path p JOIN len_of USING (seq) WHERE p.pos < frames - 1 AND frames >= 48),
pre AS (SELECT DISTINCT e.seq, e.pos, s.point FROM edges e JOIN seen s ON s.seq = e.seq AND s.pos BETWEEN e.pos - 15 AND e.pos),
post AS (SELECT DISTINCT e.seq, e.pos, s.point FROM edges e JOIN seen s ON s.seq = e.seq AND s.pos BETWEEN e.pos + 1 AND e.pos + 16),
both_sides AS (SELECT seq, pos, count(*) AS c FROM pre JOIN post USING (seq, pos, point) GROUP BY 1, 2),
overlap AS (SELECT a.seq, a.pos, coalesce(c, 0)::DOUBLE / least(a.n, b.n) AS overlap
            FROM (SELECT seq, pos, count(*) AS n FROM pre GROUP BY 1, 2) a JOIN (SELECT seq, pos, count(*) AS n FROM post GROUP BY 1, 2) b USING (seq, pos)
            LEFT JOIN both_sides USING (seq, pos)),
drops AS (SELECT a.seq, a.pos, a.overlap, CASE WHEN count(b.pos) < 3 THEN NULL WHEN a.overlap = 0 THEN 'inf'::DOUBLE WHEN median(b.overlap) <= 0 THEN NULL
                 ELSE median(b.overlap) / a.overlap END AS drop
          FROM overlap a LEFT JOIN overlap b ON a.seq = b.seq AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 24 GROUP BY 1, 2, 3)
"""


@query(
    "overlap_drop",
    roles.sql(*PATH, SEEN_SQL, OVERLAP_SQL, body="SELECT seq, pos, round(overlap, 6) AS overlap, round(drop, 9) AS drop FROM drops"),
)
def overlap_drop(spark, sf):
    f = path(spark, sf)
    lengths = f.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    d = motion.overlap_drops(motion.edge_overlaps(seen(f), lengths))
    return d.select("seq", "pos", r6("overlap", "overlap"), r6("drop", "drop", 9))


FLAGS_SQL = """
cnt0 AS (SELECT p.seq, p.pos, CAST(count(s.point) AS DOUBLE) AS n_obs FROM path p LEFT JOIN seen s ON s.seq = p.seq AND s.pos = p.pos GROUP BY 1, 2),
near0 AS (SELECT a.seq, a.pos, a.n_obs, list(b.n_obs) AS v FROM cnt0 a JOIN cnt0 b ON a.seq = b.seq AND b.pos <> a.pos AND abs(a.pos - b.pos) <= 12 GROUP BY 1, 2, 3),
mm0 AS (SELECT *, list_median(v) AS med FROM near0),
zz0 AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - med))) AS mad FROM mm0),
z0 AS (SELECT seq, pos, CASE WHEN len(v) >= 5 AND mad > 0 THEN (n_obs - med) / (1.4826 * mad) END AS obs_z FROM zz0),
lims AS (SELECT seq, 3.0 * median(step) AS lim FROM steps GROUP BY 1),
sig AS (SELECT l.seq, l.pos, l.te > lim AS f1, l.re > 15 AS f2, r.te > lim AS f3, r.re > 15 AS f4, step_ratio > 1.5 AS f5, drop > 1.8 AS f6, obs_z < -2.5 AS f7
        FROM e_left l JOIN e_right r USING (seq, pos) LEFT JOIN lims USING (seq)
        LEFT JOIN ratio q ON q.seq = l.seq AND q.pos = l.pos - 1 LEFT JOIN drops d ON d.seq = l.seq AND d.pos = l.pos - 1 LEFT JOIN z0 z ON z.seq = l.seq AND z.pos = l.pos),
flags AS (SELECT seq, pos, list_filter([CASE WHEN f1 THEN 'L.t' END, CASE WHEN f2 THEN 'L.r' END, CASE WHEN f3 THEN 'R.t' END, CASE WHEN f4 THEN 'R.r' END,
                                CASE WHEN f5 THEN 'Step' END, CASE WHEN f6 THEN 'Cov' END, CASE WHEN f7 THEN 'Obs' END], lambda x: x IS NOT NULL) AS flags FROM sig)
"""
FLAG_PARTS = (*PATH, STEPS_SQL, RATIO_SQL, SEEN_SQL, OVERLAP_SQL, _fit_sql("left"), _fit_sql("right"), FLAGS_SQL)

EDGES_SQL = """
fl AS (SELECT seq, pos, unnest(flags) AS flag FROM flags),
ed AS (SELECT seq, CASE WHEN flag LIKE 'R%' THEN pos ELSE pos - 1 END AS edge FROM fl WHERE flag <> 'Obs'),
ev AS (SELECT ed.seq, edge, count(*) AS c FROM ed JOIN (SELECT seq, count(*) AS n FROM path GROUP BY 1) USING (seq) WHERE edge >= 0 AND edge < n - 1 GROUP BY 1, 2),
ob AS (SELECT seq, unnest([pos - 1, pos]) AS edge FROM fl WHERE flag = 'Obs'),
evidence AS (SELECT ev.seq, ev.edge, c + coalesce(x, 0) AS evidence FROM ev LEFT JOIN (SELECT seq, edge, count(*) AS x FROM ob GROUP BY 1, 2) USING (seq, edge)),
common AS (SELECT a.seq, a.pos AS edge, count(*) AS shared FROM seen a JOIN seen b ON a.seq = b.seq AND b.pos = a.pos + 1 AND a.point = b.point GROUP BY 1, 2),
runs AS (SELECT e.*, coalesce(shared, 0) AS shared, edge - row_number() OVER (PARTITION BY e.seq ORDER BY edge) AS run FROM evidence e LEFT JOIN common USING (seq, edge)),
core AS (SELECT seq, edge, evidence, shared FROM runs QUALIFY row_number() OVER (PARTITION BY seq, run ORDER BY evidence DESC, shared, edge) = 1)
"""


@query("frame_flags", roles.sql(*FLAG_PARTS, body="SELECT seq, pos, array_to_string(flags, ',') AS flags FROM flags"))
def frame_flags(spark, sf):
    f = path(spark, sf)
    s = motion.discontinuity_signals(f, seen(f))
    return s.select("seq", "pos", F.concat_ws(",", "flags").alias("flags"))


def _core(spark, sf):
    f = path(spark, sf)
    flags = cut(motion.discontinuity_signals(f, seen(f)).select("seq", "pos", "flags"))
    lengths = f.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    edges = motion.flagged_edges(flags, lengths)
    s = seen(f).distinct()
    after = s.select("seq", (F.col("pos") - 1).alias("pos"), "point")
    shared = s.join(after, ["seq", "pos", "point"]).groupBy("seq", F.col("pos").alias("edge")).agg(F.count(F.lit(1)).alias("shared"))
    return motion.core_edges(edges, shared), lengths


@query("discontinuity_edges", roles.sql(*FLAG_PARTS, EDGES_SQL, body="SELECT seq, edge, evidence, shared FROM core"))
def discontinuity_edges(spark, sf):
    return _core(spark, sf)[0]


@query(
    "sequence_segments",
    roles.sql(
        *FLAG_PARTS, EDGES_SQL,
        body="""
        , ends AS (SELECT seq, edge AS last_pos FROM core UNION SELECT seq, max(pos) FROM path GROUP BY 1)
        SELECT seq, row_number() OVER w - 1 AS segment, coalesce(lag(last_pos) OVER w + 1, 0) AS first_pos, last_pos FROM ends WINDOW w AS (PARTITION BY seq ORDER BY last_pos)
        """,
    ),
)
def sequence_segments(spark, sf):
    core, lengths = _core(spark, sf)
    return motion.segments(core, lengths)


@query(
    "sequence_report",
    roles.sql(
        *PATH, STEPS_SQL,
        body="""
        , t AS (SELECT seq, avg(step) + 2.5 * stddev_pop(step) AS tl, avg(rot_deg) + 2.5 * stddev_pop(rot_deg) AS rl FROM steps GROUP BY 1)
        SELECT seq, pos, round(step, 5) AS step, round(rot_deg, 4) AS rot_deg, step > tl AS trans_flag, rot_deg > rl AS rot_flag FROM steps JOIN t USING (seq)
        """,
    ),
)
def sequence_report(spark, sf):
    """The report's rows, read back from their JSON."""
    rows = motion.sequence_report(motion.motion_path(path(spark, sf)), ["step", "rot_deg", "trans_flag", "rot_flag"])
    r = F.from_json("json", "step double, rot_deg double, trans_flag boolean, rot_flag boolean")
    return rows.select("seq", "pos", r6(r["step"], "step", 5), r6(r["rot_deg"], "rot_deg", 4), r["trans_flag"].alias("trans_flag"), r["rot_flag"].alias("rot_flag"))
