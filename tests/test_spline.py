"""The radial spline term against the basis recursion, and its inverse."""

import numpy as np
import pytest

from manyview.functions import spline


def basis(knots, i, degree, u, last):
    if degree == 0:
        return float(knots[i] <= u < knots[i + 1] or (u == last and knots[i] < last == knots[i + 1]))
    out = 0.0
    for a, b, k, w in ((knots[i], knots[i + degree], i, 1), (knots[i + 1], knots[i + degree + 1], i + 1, -1)):
        if b > a:
            out += ((u - a) if w == 1 else (b - u)) / (b - a) * basis(knots, k, degree - 1, u, last)
    return out


@pytest.mark.parametrize("size", [2, 3, 7])
def test_term_and_inverse(spark, size):
    rng = np.random.default_rng(size)
    c, limit = (0.03 * rng.normal(size=size)).tolist(), 1.7
    knots = [min(max(i - 3, 0), size - 1) * limit / (size - 1) for i in range(size + 6)]
    ds = [0.0, 1e-9, *rng.uniform(0, limit, 40), limit, 2.5]
    df = spark.createDataFrame([(float(d), c, limit) for d in ds], "d double, c array<double>, m double")
    df = df.withColumn("t", spline.spline_term("c", "m", "d"))
    rows = df.withColumn("back", spline.spline_inverse("c", "m", df["d"] + df["t.value"])).collect()
    for r in rows:
        u = min(r["d"], limit)
        want = sum(x * basis(knots, i, 3, u, limit) for i, x in enumerate([0.0, 0.0, *c]))
        assert r["t"]["value"] == pytest.approx(want, abs=1e-12) and r["back"] == pytest.approx(r["d"], abs=1e-9)
        h = 1e-6
        if h < r["d"] < limit - h:
            slope = (spline.evaluate(np.array([c]), np.array([limit]), np.array([r["d"] + h]))[0] - spline.evaluate(np.array([c]), np.array([limit]), np.array([r["d"] - h]))[0]) / (2 * h)
            assert r["t"]["slope"] == pytest.approx(slope[0], abs=1e-5)
        if r["d"] > limit:
            assert r["t"]["slope"] == 0.0


def test_without_a_term(spark):
    rows = [(1.5, None, 2.0), (1.5, [], 2.0), (1.5, [0.1], 2.0), (1.5, [0.1, 0.2], 0.0), (1.5, [0.1, 0.2], float("inf"))]
    df = spark.createDataFrame(rows, "d double, c array<double>, m double").withColumn("t", spline.spline_term("c", "m", "d"))
    for r in df.withColumn("back", spline.spline_inverse("c", "m", "d")).collect():
        assert (r["t"]["value"], r["t"]["slope"], r["back"]) == (0.0, 0.0, 1.5)
