"""The cluster census against a plain restatement, and where nothing can be judged."""

import numpy as np
import pytest

from manyview.operators import census

P = census.CensusParams()
COLS = (
    "cluster_id long, image_id long, u double, v double, fx double, fy double, ppx double, ppy double, qw double, qx double, qy double, qz double, "
    "tx double, ty double, tz double, cx double, cy double, cz double, dx double, dy double, dz double"
)


def look(center, point):
    """Pixel and ray of a camera at ``center`` that looks along -z."""
    x, y, z = np.asarray(point) - center
    return 500 + 600 * x / -z, 400 - 600 * y / -z, np.array([x, y, z]) / np.linalg.norm([x, y, z])


def scene(rng):
    """Two groups of three cameras; the second sees some points shifted, as under a wrong pose."""
    centers = [np.array([x, 0.0, 0.0]) for x in (0, 0.5, 1.0, 4.0, 4.5, 5.0)]
    rows = []
    for c in range(40):
        point = np.array([rng.uniform(-2, 6), rng.uniform(-2, 2), rng.uniform(-14, -8)])
        for i in rng.permutation(6)[: rng.integers(1, 7)]:
            shift = np.array([0.0, 0.4, 0.0]) if i >= 3 and c % 3 == 0 else 0.0
            u, v, d = look(centers[i], point + shift)
            rows.append((c, int(i), float(u), float(v), 600.0, 600.0, 500.0, 400.0, 1.0, 0.0, 0.0, 0.0, *map(float, -centers[i]), *map(float, centers[i]), *map(float, d)))
    return rows


def plain(rows, warp):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    placed = {}
    for c, own in by.items():
        if len(own) < 2:
            continue
        a, b = np.zeros((3, 3)), np.zeros(3)
        for r in own:
            m = np.eye(3) - np.outer(r[18:21], r[18:21])
            a, b = a + m, b + m @ np.array(r[15:18])
        p = np.linalg.solve(a, b)
        res, units = [], []
        for r in own:
            u, v, d = look(np.array(r[15:18]), p)
            res.append(np.hypot(u - r[2], v - r[3]))
            units.append(d)
        wide = max(np.degrees(np.arccos(np.clip(x @ y, -1, 1))) for k, x in enumerate(units) for y in units[k + 1 :])
        placed[c] = (np.median(res), wide, {r[1] // 3 for r in own})
    fine = [warp[c] for c, (m, _, _) in placed.items() if m < P.sat_px and warp[c] is not None]
    limit = np.percentile(fine, 95) if fine else np.inf
    able = {c for c in placed if warp[c] is not None and warp[c] <= limit}
    hi = [c for c in able if placed[c][1] >= 5 and placed[c][2] == {0, 1}]
    return len(able), sum(placed[c][0] < P.sat_px for c in able), len(hi), sum(placed[c][0] >= P.sat_px for c in hi)


@pytest.mark.parametrize("seed", range(2))
def test_census(spark, seed):
    rng = np.random.default_rng(seed)
    rows = scene(rng)
    warp = {c: (None if c % 11 == 5 else float(rng.random())) for c in range(40)}
    obs = spark.createDataFrame(rows, COLS).repartition(3)
    groups = spark.createDataFrame([(i, i // 3) for i in range(6)], "image_id long, group_id long")
    pairs, fine = census.cluster_census(obs, spark.createDataFrame(list(warp.items()), "cluster_id long, warp double"), groups)
    n, sat, hi, against = plain(rows, warp)
    got = pairs.collect()
    assert [(r["group_a"], r["group_b"], r["n_eligible_hi"], r["n_unsatisfied_hi"]) for r in got] == [(0, 1, hi, against)] and against > 0
    r = fine.first()
    assert (r["n_eligible"], r["n_satisfied"]) == (n, sat) and r["sat_pct"] == pytest.approx(100 * sat / n)


def test_nothing_to_judge(spark):
    obs = spark.createDataFrame(scene(np.random.default_rng(0))[:1], COLS)
    warp = spark.createDataFrame([(0, float("nan"))], "cluster_id long, warp double")
    groups = spark.createDataFrame([(i, i) for i in range(6)], "image_id long, group_id long")
    for o in (obs, obs.filter("false")):
        pairs, fine = census.cluster_census(o, warp, groups)
        assert pairs.count() == 0 and tuple(fine.first()) == (0, 0, 0.0)
