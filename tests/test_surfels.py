"""Surfel normals against a plain restatement."""

import numpy as np
import pytest

from manyview.operators import surfels

P = surfels.SurfelParams()


def plain(dirs, view):
    """One point's fit by the plain loop."""
    d, w = np.array(dirs), np.ones(len(dirs))
    axis = lambda w: np.linalg.eigh((d * w[:, None]).T @ d)
    for _ in range(P.rounds):
        r = np.abs(d @ axis(w)[1][:, 0])
        sigma = max(1.4826 * np.median(r), np.sin(np.radians(P.floor_deg)))
        u = r / (P.tukey * sigma)
        robust = np.where(u < 1, (1 - u * u) ** 2, 0)
        if robust.sum() <= 1e-12:
            break
        w = robust
    value, vector = axis(w)
    n = vector[:, 0] * (-1 if vector[:, 0] @ view < 0 else 1)
    v = view / np.linalg.norm(view)
    seed = np.array([1.0, 0, 0]) if abs(v[2]) > 0.95 else np.array([0, 0, 1.0])
    e1 = seed - (seed @ v) * v
    e1 /= np.linalg.norm(e1)
    e2 = np.cross(v, e1)
    live = w >= 0.25 * w.max()
    sectors = len({int(np.floor((np.arctan2(x @ e2, x @ e1) / (2 * np.pi) + 1) * P.sectors)) % P.sectors for x in d[live]})
    n_eff = w.sum() ** 2 / (w * w).sum()
    ratio = value[1] / value[2]
    rms = np.sqrt((w * (d @ n) ** 2).sum() / w.sum())
    sure = n_eff >= P.min_effective and sectors >= P.min_sectors and ratio >= P.min_anisotropy
    return n, len(d), n_eff, ratio, sectors, np.degrees(np.arcsin(min(sigma, 1))), np.degrees(np.arcsin(min(rms, 1))), sure


def test_against_plain_fit(spark):
    """Patches of a noisy plane, some neighbours far off it, points of few neighbours, and one of many."""
    rng = np.random.default_rng(2)
    rows, views = [], {}
    for p in range(30):
        n = [1, 2, 3, 5, 9, 400][p % 6]
        frame = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        d = rng.normal(size=(n, 3)) * [1, 1, 0.03]
        off = rng.random(n) < (0.2 if n > 4 else 0)
        d[off] = rng.normal(size=(off.sum(), 3))
        d = (d / np.linalg.norm(d, axis=1, keepdims=True)) @ frame.T
        rows += [(p, *map(float, v)) for v in d]
        views[p] = rng.normal(size=3)
    dirs = spark.createDataFrame(rows, "p long, dx double, dy double, dz double").repartition(4)
    seen = spark.createDataFrame([(p, *map(float, v)) for p, v in views.items()], "p long, vx double, vy double, vz double")
    got = {r["p"]: r for r in surfels.surfel_normals(dirs, seen).collect()}
    assert set(got) == {p for p in range(30) if p % 6}
    for p, r in got.items():
        n, count, n_eff, ratio, sectors, sigma, rms, sure = plain([x[1:] for x in rows if x[0] == p], views[p])
        assert np.allclose([r["nx"], r["ny"], r["nz"]], n, atol=1e-6)
        assert (r["n_support"], r["sectors"], r["determined"]) == (count, sectors, sure)
        assert [r["n_eff"], r["anisotropy"], r["sigma_deg"], r["resid_deg"]] == pytest.approx([n_eff, ratio, sigma, rms], abs=1e-5)


def test_directions_skip_coinciding_points(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 2.0), (2, 0.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    pairs = spark.createDataFrame([(0, 1), (2, 0)], "p long, q long")
    got = sorted(tuple(r) for r in surfels.directions(points, pairs).collect())
    assert got == [(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, -1.0)]
    assert surfels.surfel_normals(surfels.directions(points, pairs.filter("false")), points.selectExpr("point_id AS p", "x AS vx", "y AS vy", "z AS vz")).count() == 0


def test_crowded_points_go_in_rounds(spark):
    """The pass over whole points and the rounds through shuffles give the same."""
    rng = np.random.default_rng(4)
    rows = []
    for p in range(12):
        d = rng.normal(size=([2, 7, 30, 60][p % 4], 3)) * [1, 1, 0.1]
        rows += [(p, *map(float, v)) for v in d / np.linalg.norm(d, axis=1, keepdims=True)]
    dirs = spark.createDataFrame(rows, "p long, dx double, dy double, dz double").repartition(3)
    views = spark.createDataFrame([(p, *map(float, rng.normal(size=3))) for p in range(12)], "p long, vx double, vy double, vz double")
    one, two, three = ({r["p"]: r for r in surfels.surfel_normals(dirs, views, whole=n).collect()} for n in (100, 20, 1))
    assert len(one) == 12 and one.keys() == two.keys() == three.keys()
    for p, r in one.items():
        for other in (two, three):
            assert list(r) == pytest.approx(list(other[p]), abs=1e-6)


def test_whole_points_are_cut_once(spark, monkeypatch):
    """Directions are written once and not again in every round."""
    cuts = []
    monkeypatch.setattr(surfels, "cut", lambda df: cuts.append(df.columns) or df.localCheckpoint())
    dirs = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (0, 0.0, 1.0, 0.0), (0, 0.6, 0.8, 0.0)], "p long, dx double, dy double, dz double")
    views = spark.createDataFrame([(0, 0.0, 0.0, 1.0)], "p long, vx double, vy double, vz double")
    assert surfels.surfel_normals(dirs, views).count() == 1
    assert cuts == [["p", "dx", "dy", "dz"], ["p"]]
