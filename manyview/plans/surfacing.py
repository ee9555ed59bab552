"""Surface normals over the observation adjacency of the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, surfels
from . import roles
from .graphs import ADJ_SQL, adjacency_input
from .registry import query, r6


def _plane_sql(tag: str, rows: str) -> str:
    """Smallest axis by squaring (trace - matrix) until only it is left."""
    return f"""
{tag}_m AS (SELECT p, [[sum(w * dx * dx), sum(w * dx * dy), sum(w * dx * dz)], [sum(w * dx * dy), sum(w * dy * dy), sum(w * dy * dz)], [sum(w * dx * dz), sum(w * dy * dz), sum(w * dz * dz)]] AS a FROM {rows} GROUP BY p),
{tag}_pow AS (
  SELECT p, 0 AS step, [[(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) - a[x][y] / (a[1][1] + a[2][2] + a[3][3]) FOR y IN [1, 2, 3]] FOR x IN [1, 2, 3]] AS m FROM {tag}_m
  UNION ALL
  SELECT p, step + 1, [[v / (s[1][1] + s[2][2] + s[3][3]) FOR v IN r] FOR r IN s] FROM (SELECT p, step, [[list_dot_product(x, y) FOR y IN m] FOR x IN m] AS s FROM {tag}_pow WHERE step < 40)),
{tag}_v AS (SELECT p, m[list_position([m[1][1], m[2][2], m[3][3]], greatest(m[1][1], m[2][2], m[3][3]))] AS v FROM {tag}_pow WHERE step = 40),
{tag}_n AS (SELECT p, v[1] / sqrt(list_dot_product(v, v)) AS nx, v[2] / sqrt(list_dot_product(v, v)) AS ny, v[3] / sqrt(list_dot_product(v, v)) AS nz FROM {tag}_v),
{tag}_r AS (SELECT t.*, abs(dx * nx + dy * ny + dz * nz) AS r FROM {rows} t JOIN {tag}_n USING (p))"""


def _round_sql(n: int) -> str:
    return f"""{_plane_sql(f"k{n}", f"w{n}")},
k{n}_s AS (SELECT p, greatest(1.4826 * median(r), sin(radians(2.0))) AS s FROM k{n}_r GROUP BY p),
k{n}_u AS (SELECT k.*, s, CASE WHEN r < 4.685 * s THEN (1 - (r / (4.685 * s)) ** 2) ** 2 ELSE 0.0 END AS rob FROM k{n}_r k JOIN k{n}_s USING (p)),
k{n}_t AS (SELECT p, sum(rob) > 1e-12 AS moves FROM k{n}_u GROUP BY p),
w{n + 1} AS (SELECT p, dx, dy, dz, CASE WHEN live AND moves THEN rob ELSE w END AS w, live AND moves AS live, CASE WHEN live THEN s ELSE sigma END AS sigma FROM k{n}_u JOIN k{n}_t USING (p))"""


SURFEL_SQL = f"""
sides AS (SELECT p, q FROM near UNION ALL SELECT q, p FROM near),
dirs AS (SELECT p, (b.x - a.x) / l AS dx, (b.y - a.y) / l AS dy, (b.z - a.z) / l AS dz FROM (
  SELECT sides.p, a, b, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS l FROM sides JOIN points a ON a.point_id = sides.p JOIN points b ON b.point_id = sides.q) WHERE l > 1e-12),
w0 AS (SELECT p, dx, dy, dz, 1.0::DOUBLE AS w, true AS live, 'nan'::DOUBLE AS sigma FROM dirs QUALIFY count(*) OVER (PARTITION BY p) >= 2),
{_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)}, {_plane_sql("z", "w3")},
facing AS (SELECT *, CASE WHEN nx * (1 + p % 3) + ny * (p % 5 - 2) + nz * 2 < 0 THEN -1.0 ELSE 1.0 END AS s FROM z_n),
fin AS (SELECT p, count(*) AS n_support, sum(w) ** 2 / sum(w * w) AS n_eff, any_value(sigma) AS sigma, sqrt(sum(w * r * r) / sum(w)) AS rms FROM z_r GROUP BY p)
"""


@query(
    "surfel_normals",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, roles.POINTS_SQL, roles.OBS_SQL, ADJ_SQL, SURFEL_SQL,
        body="""SELECT p, round(nx * s, 4) + 0.0 AS nx, round(ny * s, 4) + 0.0 AS ny, round(nz * s, 4) + 0.0 AS nz, n_support, round(n_eff, 5) AS n_eff,
                round(degrees(asin(least(sigma, 1.0))), 5) AS sigma_deg, round(degrees(asin(least(rms, 1.0))), 4) AS resid_deg FROM facing JOIN fin USING (p) WHERE n_support >= 4""",
    ),
)
def surfel_normals(spark, sf):
    """Normals of points with four neighbours in the observation adjacency, and how well they are supported."""
    pairs = coverage.adjacency_candidates(adjacency_input(spark, sf), 10.0, 1.0)
    points = roles.points(spark, sf)
    k = F.col("point_id")
    views = points.select(k.alias("p"), (1.0 + k % 3).alias("vx"), (k % 5 - 2.0).alias("vy"), F.lit(2.0).alias("vz"))
    out = surfels.surfel_normals(surfels.directions(points, pairs), views).filter("n_support >= 4")
    return out.select(
        "p", *[(r6(c, c, 4) + 0.0).alias(c) for c in ("nx", "ny", "nz")], "n_support", r6("n_eff", "n_eff", 5),
        r6("sigma_deg", "sigma_deg", 5), r6("resid_deg", "resid_deg", 4),
    )
