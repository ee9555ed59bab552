"""The radial spline term on the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spline
from . import roles
from .registry import query, r6

COEFFICIENTS = (0.02, -0.01, 0.03, 0.015, 0.05)
LIMIT = 4.0
_PIECES = len(COEFFICIENTS) - 1
_KNOTS = [min(max(i - 3, 0), _PIECES) * LIMIT / _PIECES for i in range(_PIECES + 7)]


def _basis_sql(level: int) -> str:
    """The basis recursion over knots, one level; a part over no span is zero."""
    part = lambda x, y, n: f"CASE WHEN {y} > {x} THEN {n} / ({y} - {x}) ELSE 0.0 END"
    a = part("k[a.i]", f"k[a.i + {level}]", "(a.u - k[a.i]) * a.b")
    b = part("k[a.i + 1]", f"k[a.i + {level + 1}]", f"(k[a.i + {level + 1}] - a.u) * c.b")
    return f"b{level} AS (SELECT a.u, a.i, {a} + {b} AS b FROM b{level - 1} a JOIN b{level - 1} c ON c.u = a.u AND c.i = a.i + 1, kn)"


SPLINE_SQL = f"""
WITH kn AS (SELECT {_KNOTS} AS k),
d AS (SELECT DISTINCT l_quantity / 10.0 AS d, least(l_quantity / 10.0, {LIMIT}) AS u FROM lineitem),
b0 AS (SELECT u, i, CASE WHEN (u >= k[i] AND u < k[i + 1]) OR (u = {LIMIT} AND k[i + 1] = {LIMIT} AND k[i] < {LIMIT}) THEN 1.0 ELSE 0.0 END::DOUBLE AS b
  FROM (SELECT DISTINCT u FROM d), range(1, {len(_KNOTS)}) t(i), kn),
{_basis_sql(1)}, {_basis_sql(2)}, {_basis_sql(3)},
co AS (SELECT {[0.0, 0.0, *COEFFICIENTS]} AS c),
val AS (SELECT u, sum(c[i] * b) AS value FROM b3, co GROUP BY u),
slo AS (SELECT u, sum(CASE WHEN k[i + 3] > k[i] THEN 3 * (c[i] - coalesce(c[i - 1], 0.0)) / (k[i + 3] - k[i]) ELSE 0.0 END * b) AS slope FROM b2, co, kn WHERE i BETWEEN 2 AND {len(COEFFICIENTS) + 2} GROUP BY u)
SELECT l_orderkey, l_linenumber, round(value * (1 + l_partkey % 3), 9) + 0.0 AS term, round(CASE WHEN d > {LIMIT} THEN 0.0 ELSE slope * (1 + l_partkey % 3) END, 9) + 0.0 AS slope, round(d, 9) AS back
FROM lineitem JOIN d ON d.d = l_quantity / 10.0 JOIN val USING (u) JOIN slo USING (u)"""


@query("spline_round_trip", SPLINE_SQL)
def spline_round_trip(spark, sf):
    """Distances through the radial term and back, with the term's value and slope."""
    li = roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10.0).alias("d"), (1 + F.col("l_partkey") % 3).alias("s"))
    li = li.withColumn("c", F.array(*[F.lit(c) * F.col("s") for c in COEFFICIENTS]))
    term = li.withColumn("t", spline.spline_term("c", F.lit(LIMIT), "d"))
    back = spline.spline_inverse("c", F.lit(LIMIT), F.col("d") + F.col("t.value"))
    return term.select("l_orderkey", "l_linenumber", (F.round("t.value", 9) + 0.0).alias("term"), (F.round("t.slope", 9) + 0.0).alias("slope"), r6(back, "back", 9))
