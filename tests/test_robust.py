"""Robust two-view models on planted matches."""

import numpy as np
import pytest

from manyview.operators import robust


def scene(rng, n):
    """Pixels of points in two cameras of focal length 800 and their fundamental matrix."""
    angle = rng.uniform(-0.2, 0.2, 3)
    k = np.array([[0, -angle[2], angle[1]], [angle[2], 0, -angle[0]], [-angle[1], angle[0], 0]])
    rot = np.linalg.qr(np.eye(3) + k)[0]
    rot *= np.sign(np.linalg.det(rot)) * np.sign(np.trace(rot))
    t = np.array([1.0, 0.3, 0.2]) + rng.uniform(-0.2, 0.2, 3)
    p = np.column_stack((rng.uniform(-3, 3, (n, 2)), rng.uniform(4, 12, n)))
    q = p @ rot.T + t
    cam = np.array([[800.0, 0, 500], [0, 800.0, 400], [0, 0, 1]])
    inv = np.linalg.inv(cam)
    f = inv.T @ np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ rot @ inv
    pix = lambda x: (x @ cam.T)[:, :2] / x[:, 2:]
    return np.column_stack((pix(p), pix(q))), f / np.linalg.norm(f)


def frame(spark, parts):
    rows = [(pair, *map(float, r)) for pair, m in parts for r in m]
    return spark.createDataFrame(rows, "pair long, x double, y double, u double, v double").repartition(4)


def test_fundamental_with_outliers(spark):
    """A pair with a third of all rows beside small ones; 35 % of the matches are off."""
    rng = np.random.default_rng(1)
    parts, truth = [], {}
    for pair, n in ((1, 900), (2, 120), (3, 300), (4, 400), (5, 10)):
        m, f = scene(rng, n)
        m += 0.2 * rng.normal(size=m.shape)
        bad = rng.random(n) < 0.35
        m[bad, 2:] = rng.uniform(0, 1000, (bad.sum(), 2))
        parts.append((pair, m))
        truth[pair] = (f, m, bad)
    got = {r["pair"]: r for r in robust.estimate(frame(spark, parts), robust.FUNDAMENTAL).collect()}
    assert set(got) == {1, 2, 3, 4}
    for pair, r in got.items():
        f, m, bad = truth[pair]
        own = np.array(r["model"])
        good = robust._sampson_of(own[None], m[~bad])[0] <= 9
        assert good.mean() >= 0.97 and r["n"] == len(m) and r["inliers"] >= (~bad).sum() * 0.97
        assert r["inliers"] == (robust._sampson_of(own[None], m)[0] <= 9).sum()
        assert np.linalg.matrix_rank(own.reshape(3, 3), tol=1e-9 * np.linalg.norm(own)) == 2


def test_homography_with_outliers(spark):
    rng = np.random.default_rng(2)
    h = np.array([[1.1, 0.05, 30], [-0.04, 0.95, 12], [1e-4, -5e-5, 1]])
    x = rng.uniform(0, 1000, (400, 2))
    q = np.column_stack((x, np.ones(400))) @ h.T
    m = np.column_stack((x, q[:, :2] / q[:, 2:] + 0.3 * rng.normal(size=(400, 2))))
    m[:160, 2:] += rng.uniform(50, 400, (160, 2))
    r = robust.estimate(frame(spark, [(7, m)]), robust.HOMOGRAPHY).collect()[0]
    to = np.column_stack((x, np.ones(400))) @ np.array(r["model"]).reshape(3, 3).T
    assert r["inliers"] == 240 and np.abs(to[:, :2] / to[:, 2:] - q[:, :2] / q[:, 2:]).max() < 4


def test_unusable_rows_and_degenerate_pairs(spark):
    nan, rng = float("nan"), np.random.default_rng(3)
    m, _ = scene(rng, 60)
    rows = [(1, *map(float, r)) for r in m] + [(1, None, 1.0, 2.0, 3.0), (1, nan, 1.0, 2.0, 3.0), (1, 1.0, float("inf"), 2.0, 3.0)]
    rows += [(2, 5.0, 5.0, 6.0, 6.0)] * 30 + [(3, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "pair long, x double, y double, u double, v double")
    got = robust.estimate(df, robust.FUNDAMENTAL).collect()
    assert [(r["pair"], r["n"], r["inliers"]) for r in got if r["pair"] == 1] == [(1, 60, 60)]
    assert all(r["pair"] in (1, 2) for r in got)
    assert robust.estimate(df.filter("false"), robust.FUNDAMENTAL).count() == 0


@pytest.mark.parametrize("model", [robust.FUNDAMENTAL, robust.HOMOGRAPHY])
def test_columns_and_arrays_agree(spark, model):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    m, own = rng.uniform(0, 500, (20, 4)), rng.normal(size=9)
    df = frame(spark, [(0, m)]).withColumn("m", F.array(*[F.lit(float(v)) for v in own]))
    got = {(r["x"], r["y"]): r["e"] for r in df.withColumn("e", model.error(F.col("m"), *(F.col(c) for c in "xyuv"))).collect()}
    want = model.error_of(own[None], m)[0]
    assert all(got[m[i, 0], m[i, 1]] == pytest.approx(want[i], rel=1e-9) for i in range(20))


def test_hypotheses_in_closed_form(spark):
    """Four points in general position and three on a line: what the linear system says, and only its rows go there."""
    rng = np.random.default_rng(4)
    rows = rng.uniform(0, 1000, (200, 4, 4))
    rows[150:, 2] = (rows[150:, 0] + rows[150:, 1]) / 2
    seen, solve = [], robust._null_of
    robust._null_of = lambda a: (seen.append(len(a)), solve(a))[1]
    try:
        got = robust._propose_homography(rows)
    finally:
        robust._null_of = solve
    assert 50 <= sum(seen) < 100
    for h, r in zip(got[:150], rows):
        q = np.column_stack((r[:, :2], np.ones(4))) @ h.reshape(3, 3).T
        assert np.allclose(q[:, :2] / q[:, 2:], r[:, 2:], atol=1e-4)
