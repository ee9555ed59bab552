"""Image-pair matching under known poses, on descriptors that serve as features of the images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera
from ..operators import geomatch as G
from . import roles
from .registry import query, r6

WINDOW = 16
MARGIN = 50.0

_K = "FOR k IN [1, 2, 3]"


def steps(name: str, start: str, *columns: str) -> str:
    """One subquery per group of columns, so that no expression is repeated inside another."""
    parts = [f"{name}_0 AS ({start})"]
    for n, c in enumerate(columns, 1):
        parts.append(f"{name}{'' if n == len(columns) else f'_{n}'} AS (SELECT *, {c} FROM {name}_{n - 1})")
    return ",\n".join(parts)


def _inside(side: str) -> str:
    return f"{side}ex BETWEEN {-MARGIN} AND {1000 + MARGIN} AND {side}ey BETWEEN {-MARGIN} AND {800 + MARGIN} AS {side}in"


def _epipole(side: str, v: str) -> str:
    return f"CASE WHEN abs({v}[3]) > 0 THEN {side}f * {v}[1] / {v}[3] + 500.0 END AS {side}ex, CASE WHEN abs({v}[3]) > 0 THEN {side}f * {v}[2] / {v}[3] + 400.0 END AS {side}ey"


_STEPS = steps(
    "g",
    """SELECT a.image_id AS pair, a.image_id AS i, b.image_id AS j, a.r AS ar, b.r AS br, a.t AS att, b.t AS btt, a.f AS af, b.f AS bf, (a.f + b.f) / 2 AS nf
       FROM posed a JOIN posed b ON b.image_id = a.image_id + 1""",
    "[[list_dot_product(x, y) FOR y IN ar] FOR x IN br] AS m",
    f"[btt[k] - list_dot_product(m[k], att) {_K}] AS tr, [[m[1][k], m[2][k], m[3][k]] {_K}] AS mt",
    f"[-list_dot_product(mt[k], tr) {_K}] AS back",
    f"{_epipole('a', 'back')}, {_epipole('b', 'tr')}",
    f"{_inside('a')}, {_inside('b')}",
    """ain OR bin AS polar, [[tr[2] * m[3][k] - tr[3] * m[2][k], tr[3] * m[1][k] - tr[1] * m[3][k]] FOR k IN [1, 2]] AS ess,
       [-pi() + 2 * pi() * k / 36 FOR k IN range(36)] AS ways, sqrt(1 + m[1][1] + m[2][2] + m[3][3]) / 2 AS qw""",
    """[[w, ess[1][1] * cos(w) + ess[2][1] * sin(w), ess[1][2] * cos(w) + ess[2][2] * sin(w)] FOR w IN ways] AS dirs,
       [1 + qw, (m[3][2] - m[2][3]) / (4 * qw), (m[1][3] - m[3][1]) / (4 * qw), (m[2][1] - m[1][2]) / (4 * qw)] AS q0""",
    """[[d[1], atan2(sin(atan2(d[2], -d[3]) - d[1]), cos(atan2(d[2], -d[3]) - d[1])), atan2(sin(atan2(-d[2], d[3]) - d[1]), cos(atan2(-d[2], d[3]) - d[1]))] FOR d IN dirs] AS turns,
       [x / sqrt(list_dot_product(q0, q0)) FOR x IN q0] AS q""",
    """list_sort([CASE WHEN abs(d[2]) > pi() / 2 THEN d[3] ELSE d[2] END FOR d IN turns])[19] AS turn,
       [[1 - 2 * (q[3] * q[3] + q[4] * q[4]), 2 * (q[2] * q[3] - q[1] * q[4]), 2 * (q[2] * q[4] + q[1] * q[3])],
        [2 * (q[2] * q[3] + q[1] * q[4]), 1 - 2 * (q[2] * q[2] + q[4] * q[4]), 2 * (q[3] * q[4] - q[1] * q[2])],
        [2 * (q[2] * q[4] - q[1] * q[3]), 2 * (q[3] * q[4] + q[1] * q[2]), 1 - 2 * (q[2] * q[2] + q[3] * q[3])]] AS h""",
    f"[[h[1][k], h[2][k], h[3][k]] {_K}] AS ht",
    f"[list_dot_product(ht[k], tr) {_K}] AS b0",
    "sqrt(list_dot_product(b0, b0)) AS base",
    "[x / base FOR x IN b0] AS e1",
    "sqrt(e1[1] * e1[1] + e1[2] * e1[2]) AS flat",
    "[-e1[2] / flat, e1[1] / flat, 0.0] AS e2",
    "[e1[2] * e2[3] - e1[3] * e2[2], e1[3] * e2[1] - e1[1] * e2[3], e1[1] * e2[2] - e1[2] * e2[1]] AS e3",
) + ","

# Poses of both sides as matrices in the optical frame, then the pair's geometry step by step.
GEOMETRY_SQL = f"""
posed AS (
  SELECT image_id, [[r00, r01, r02], [-r10, -r11, -r12], [-r20, -r21, -r22]] AS r, [tx, -ty, -tz] AS t, 500.0 + 10 * n_nationkey AS f
  FROM poses JOIN nation ON n_nationkey = camera_id),
{_STEPS}
feats AS (
  SELECT label + 1 AS image_id, vec_id AS fid, 500.0 + 1500.0 * embedding[1]::DOUBLE AS x, 400.0 + 1200.0 * embedding[2]::DOUBLE AS y,
    embedding[3]::DOUBLE AS a11, embedding[4]::DOUBLE AS a12, embedding[5]::DOUBLE AS a21, embedding[6]::DOUBLE AS a22, embedding AS descriptor
  FROM embeddings)
"""


def _side_sql(side: str, image: str, order: str) -> str:
    """Features of one side of all pairs in order, with the ghosts of polar pairs in a second table."""
    polar = {"auto": "polar", "polar": "TRUE"}.get(order, "FALSE")
    own = "TRUE" if order == "given" else polar
    h, f = ("h", "af") if side == "a" else ("ht", "bf")
    theta = f"atan2(y - {side}ey, x - {side}ex)"
    if side == "b":
        theta = f"atan2(sin({theta} - turn), cos({theta} - turn))"
    shift = " - nf * base" if side == "b" else ""
    place = steps(
        f"{side}_in",
        f"SELECT fid, descriptor, a11, a12, a21, a22, x, y, g.*, {polar} AS isp, [(x - 500.0) / {f}, (y - 400.0) / {f}, 1.0] AS ray FROM feats JOIN g ON g.{image} = feats.image_id",
        f"[list_dot_product({h}[k], ray) {_K}] AS v3, sqrt((x - {side}ex) ** 2 + (y - {side}ey) ** 2) AS radius",
        "list_dot_product(e3, v3) AS dep",
        f"(nf * list_dot_product(e1, v3) + 500.0 * dep{shift}) / dep AS rx, nf * list_dot_product(e2, v3) / dep + 400.0 AS ry",
        f"""CASE WHEN {polar} THEN {theta} WHEN {order == 'given'} THEN y ELSE ry END AS v, CASE WHEN {polar} THEN radius ELSE 0.0 END AS tie,
            CASE WHEN {own} THEN x ELSE rx END AS px, CASE WHEN {own} THEN y ELSE ry END AS py""",
    )
    return f"""
{place},
{side}_fine AS (SELECT pair, fid, descriptor, a11, a12, a21, a22, isp, radius, v, tie, px, py FROM {side}_in),
{side}_f AS (SELECT * FROM {side}_fine WHERE v IS NOT NULL AND (NOT isp OR radius >= 10.0)),
{side}_m AS (SELECT *, least(pi() / 4, 2 * pi() * {WINDOW} / count(*) OVER (PARTITION BY pair)) AS wide FROM {side}_f),
{side}_g AS (
  SELECT pair, fid, v, tie FROM {side}_m UNION ALL SELECT pair, fid, v + 2 * pi(), tie FROM {side}_m WHERE isp AND v < -pi() + wide
  UNION ALL SELECT pair, fid, v - 2 * pi(), tie FROM {side}_m WHERE isp AND v > pi() - wide),
{side}_t AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY v, tie, fid) - 1 AS k, count(*) OVER (PARTITION BY pair) AS n FROM {side}_g)"""


def _way_sql(tag: str, one: str, two: str, tested: bool) -> str:
    """Best candidates of side ``one`` among ``two``; depths come from the smallest eigenvector of the linear system,
    by squaring (trace - matrix) until only it is left."""
    m = "m" if one == "a" else "mt"
    met = f"""
{tag}_mid AS (SELECT pair, (v + lead(v, {WINDOW}) OVER (PARTITION BY pair ORDER BY k)) / 2.0 AS m FROM {two}_t),
{tag}_n AS (SELECT pair, any_value(n) AS n FROM {two}_t GROUP BY 1),
{tag}_s AS (SELECT q.*, greatest(least(n.n - {WINDOW}, (SELECT count(*) FROM {tag}_mid x WHERE x.pair = q.pair AND x.m < q.v)), 0) AS s
  FROM {one}_f q JOIN {tag}_n n USING (pair)),
{tag}_c AS (SELECT q.pair, q.fid AS qid, c.fid AS cid, t.k, q.px AS qx, q.py AS qy, c.px AS cx, c.py AS cy,
    [q.a11, q.a12, q.a21, q.a22] AS qa, [c.a11, c.a12, c.a21, c.a22] AS ca,
    list_sum(list_transform(list_zip(q.descriptor::DOUBLE[], c.descriptor::DOUBLE[]), lambda e: (e[1] - e[2]) * (e[1] - e[2]))) AS d2
  FROM {tag}_s q JOIN {two}_t t ON t.pair = q.pair AND t.k BETWEEN q.s AND q.s + {WINDOW - 1} JOIN {two}_f c ON c.pair = t.pair AND c.fid = t.fid)"""
    if not tested:
        return met + f",\n{tag}_ok AS (SELECT * FROM {tag}_c)"
    turned = steps(
        f"{tag}_turned",
        f"""SELECT c.*, g.* EXCLUDE (pair), [{m}[1][1] * qa[1] + {m}[1][2] * qa[3], {m}[1][1] * qa[2] + {m}[1][2] * qa[4],
              {m}[2][1] * qa[1] + {m}[2][2] * qa[3], {m}[2][1] * qa[2] + {m}[2][2] * qa[4]] AS ta,
              [(qx - 500.0) / {one}f, (qy - 400.0) / {one}f, 1.0] AS ray1, [(cx - 500.0) / {two}f, (cy - 400.0) / {two}f, 1.0] AS ray2
            FROM {tag}_c c JOIN g USING (pair)""",
        f"[list_dot_product({m}[k], ray1) {_K}] AS ray",
        "list_dot_product(ray, ray2) / (sqrt(list_dot_product(ray, ray)) * sqrt(list_dot_product(ray2, ray2))) AS ray_cos",
    )
    system = steps(
        f"{tag}_eq",
        f"SELECT id, qx, qy, cx, cy, {one}f AS f1, {two}f AS f2, [list_append({one}r[k], {one}tt[k]) {_K}] AS po, [list_append({two}r[k], {two}tt[k]) {_K}] AS pt FROM {tag}_near WHERE ray_cos <= cos(radians(5.0))",
        """[[(qx - 500.0) * po[3][k] - f1 * po[1][k] FOR k IN [1, 2, 3, 4]], [(qy - 400.0) * po[3][k] - f1 * po[2][k] FOR k IN [1, 2, 3, 4]],
            [(cx - 500.0) * pt[3][k] - f2 * pt[1][k] FOR k IN [1, 2, 3, 4]], [(cy - 400.0) * pt[3][k] - f2 * pt[2][k] FOR k IN [1, 2, 3, 4]]] AS eqs""",
        "[[list_sum([e[x] * e[y] FOR e IN eqs]) FOR y IN [1, 2, 3, 4]] FOR x IN [1, 2, 3, 4]] AS sys",
        "sys[1][1] + sys[2][2] + sys[3][3] + sys[4][4] AS size",
    )
    return met + f""",
{turned},
{tag}_near AS (
  SELECT *, row_number() OVER () AS id FROM {tag}_turned
  WHERE (ta[1] * ca[1] + ta[3] * ca[3]) / (sqrt(ta[1] * ta[1] + ta[3] * ta[3]) * sqrt(ca[1] * ca[1] + ca[3] * ca[3])) >= cos(radians(15.0))),
{system},
{tag}_pow AS (
  SELECT id, 0 AS step, [[(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) - sys[x][y] / size FOR y IN [1, 2, 3, 4]] FOR x IN [1, 2, 3, 4]] AS p FROM {tag}_eq
  UNION ALL
  SELECT id, step + 1, [[v / big FOR v IN r] FOR r IN sq] FROM (
    SELECT *, sq[1][1] + sq[2][2] + sq[3][3] + sq[4][4] AS big FROM (SELECT id, step, [[list_dot_product(a, b) FOR b IN p] FOR a IN p] AS sq FROM {tag}_pow WHERE step < 44))),
{tag}_point AS (SELECT id, p[list_position([p[1][1], p[2][2], p[3][3], p[4][4]], greatest(p[1][1], p[2][2], p[3][3], p[4][4]))] AS v FROM {tag}_pow WHERE step = 44),
{tag}_depth AS (SELECT id, list_dot_product(po[3], v) / v[4] AS d1, list_dot_product(pt[3], v) / v[4] AS d2 FROM {tag}_point JOIN {tag}_eq USING (id)),
{tag}_ok AS (
  SELECT n.* FROM {tag}_near n LEFT JOIN {tag}_depth d USING (id)
  WHERE ray_cos > cos(radians(5.0)) OR (d.d1 > 0 AND d.d2 > 0
    AND 0.5 * (sqrt(ca[1] ** 2 + ca[3] ** 2) + sqrt(ca[2] ** 2 + ca[4] ** 2)) / (d.d1 / d.d2 * 0.5 * (sqrt(ta[1] ** 2 + ta[3] ** 2) + sqrt(ta[2] ** 2 + ta[4] ** 2))) BETWEEN 0.8 AND 1.25))"""


def _sql(order: str, tested: bool) -> str:
    best = lambda tag: f"{tag}_b AS (SELECT pair, qid, cid, d2 FROM {tag}_ok QUALIFY row_number() OVER (PARTITION BY pair, qid ORDER BY d2, k, cid) = 1)"
    return roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, GEOMETRY_SQL, _side_sql("a", "i", order), _side_sql("b", "j", order),
        _way_sql("fw", "a", "b", tested), _way_sql("bw", "b", "a", tested), best("fw"), best("bw"),
        body="SELECT f.pair, f.qid AS l, f.cid AS r, round(f.d2, 6) AS d2 FROM fw_b f JOIN bw_b b ON b.pair = f.pair AND b.qid = f.cid AND b.cid = f.qid",
    )


def _geometry(spark, sf):
    images = roles.images(spark, sf)
    k = camera.intrinsics()
    cams = roles.harness_cameras(roles.table(spark, sf, "nation")).select("camera_id", "width", "height", *[c.alias(n) for n, c in k.items()])
    pairs = images.select(F.col("image_id").alias("pair"), F.col("image_id").alias("i"), (F.col("image_id") + 1).alias("j"))
    return G.pair_geometry(pairs, images, cams, MARGIN)


def _features(spark, sf):
    d = lambda k: F.col("embedding")[k].cast("double")
    return roles.table(spark, sf, "embeddings").select(
        (F.col("label") + 1).cast("long").alias("image_id"), F.col("vec_id").alias("fid"),
        (500.0 + 1500.0 * d(0)).alias("x"), (400.0 + 1200.0 * d(1)).alias("y"),
        *[d(k).alias(n) for k, n in enumerate(G.SHAPE, 2)], F.col("embedding").alias("descriptor"),
    )


def _matches(spark, sf, order, test):
    found = G.match_pairs(_features(spark, sf), _geometry(spark, sf), WINDOW, None, test, order)
    return found.select("pair", "l", "r", r6("d2", "d2"))


@query("geometric_sweep_match", _sql("given", True))
def geometric_sweep_match(spark, sf):
    """Sweep along the images' own rows, candidates tested by turn and size."""
    return _matches(spark, sf, "given", G.ShapeTest())


@query("polar_sweep_match", _sql("polar", False))
def polar_sweep_match(spark, sf):
    """Sweep by the angle about the epipoles, across the seam."""
    return _matches(spark, sf, "polar", None)


@query("image_pair_match", _sql("auto", True))
def image_pair_match(spark, sf):
    """Rectified rows or polar angles, whichever the pair allows, with the candidate test."""
    return _matches(spark, sf, "auto", G.ShapeTest())


@query(
    "rectification_choice",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, GEOMETRY_SQL,
        body="""SELECT pair, j, polar, round(turn, 6) AS turn, round(base, 6) AS base, round(e1[1], 6) AS ux, round(e1[2], 6) AS uy, round(e2[1], 6) AS vx, round(e2[2], 6) AS vy FROM g""",
    ),
)
def rectification_choice(spark, sf):
    """Whether each pair can be rectified, the turn between its epipolar pencils, and its rectifying axes."""
    g = _geometry(spark, sf)
    return g.select("pair", "j", "polar", r6("turn", "turn"), r6("base", "base"), r6("ux", "ux"), r6("uy", "uy"), r6("vx", "vx"), r6("vy", "vy"))
