"""Draws and scores of the robust similarity against plain loops, and whatever way rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyview.operators import align

COLS = ["sx", "sy", "sz", "tx", "ty", "tz"]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=(500, 3))
    sim = align.Similarity.from_axis_angle([1, 2, 3], 0.7, [1.0, -2.0, 0.5], 1.5)
    t = 1.5 * s @ sim.rotation.T + sim.translation
    t[::4] += 20.0
    rows = [(i, *map(float, r)) for i, r in enumerate(np.column_stack((s, t)))]
    return spark.createDataFrame(rows + rows[:50], "pair_id long, " + ", ".join(f"{c} double" for c in COLS))


def test_draws(pairs):
    n = 30
    hashed = {r["pair_id"]: (r["h"], tuple(r[c] for c in COLS)) for r in pairs.withColumn("h", F.xxhash64(F.lit(7), "pair_id")).collect()}
    h = np.array([v[0] for v in hashed.values()], np.int64).view(np.uint64)
    want = [list(hashed.values())[int(align._mix(h + align._mix(np.uint64(k + 1))).argmin())][1] for k in range(n)]
    assert len(set(want)) > n // 2
    for parts in (1, 7):
        assert align._draws(pairs.repartition(parts), n, 7) == want
    assert align._draws(pairs.filter("false"), n, 7) == []


def test_scores_and_fit(pairs):
    good = align.Similarity.from_axis_angle([1, 2, 3], 0.7, [1.0, -2.0, 0.5], 1.5)
    none = align.Similarity(np.eye(3), np.full(3, 1e6))
    assert align._scores(pairs.repartition(5), [none, good], 0.1) == [0, 375 + 37]
    sim, inliers = align.ransac_similarity(pairs, 0.1, 48)
    assert inliers == 375 + 37 and np.allclose(sim.rotation, good.rotation) and abs(sim.scale - 1.5) < 1e-9
