"""Discovery of points at infinity against the plain walk; the radius join with hot cells."""

import itertools
import math

import numpy as np
import pytest

from manyview.operators import infinity, knn, skew


def plain(rows, p):
    """Tracks of (fid, image, direction, descriptor) rows by comparing all pairs."""
    chord = math.sqrt(2 * (1 - math.cos(math.radians(p.eps_deg))))
    best = {}
    for a in rows:
        per = {}
        for b in rows:
            if b[1] != a[1] and np.linalg.norm(a[2] - b[2]) <= chord:
                per.setdefault(b[1], []).append((float(((a[3] - b[3]) ** 2).sum()), b[0]))
        for found in per.values():
            found.sort()
            if found[0][0] < p.max_distance**2 and (len(found) < 2 or found[0][0] < p.ratio**2 * found[1][0]):
                best[a[0], found[0][1]] = found[0][0]
    links = {(a, b): d for (a, b), d in best.items() if (b, a) in best}
    root = {a: a for a, _ in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    image = {r[0]: r[1] for r in rows}
    support = {}
    for (a, _), d in links.items():
        support[a] = support.get(a, 0.0) + d
    tracks = {}
    for a in root:
        key = (find(a), image[a])
        tracks[key] = min(tracks.get(key, (math.inf, 0)), (support[a], a))
    views = {}
    for t, i in tracks:
        views.setdefault(t, set()).add(i)
    return {(t, i, f) for (t, i), (_, f) in tracks.items() if len(views[t]) >= p.min_views}


def scene(rng, n_far, images):
    """Far points seen by all images within a little noise, and features seen once."""
    rows, fid = [], 0
    for _ in range(n_far):
        d, e = rng.normal(size=3), rng.integers(0, 200, 8)
        for i in rng.permutation(images)[: rng.integers(2, images + 1)]:
            v = d / np.linalg.norm(d) + 1e-3 * rng.normal(size=3)
            rows.append((fid, int(i), v / np.linalg.norm(v), (e + rng.integers(-2, 3, 8)).astype(float)))
            fid += 1
    for _ in range(40):
        v = rng.normal(size=3)
        rows.append((fid, int(rng.integers(images)), v / np.linalg.norm(v), rng.integers(0, 200, 8).astype(float)))
        fid += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(f, i, *map(float, d), e.tolist()) for f, i, d, e in rows], "fid long, image_id long, dx double, dy double, dz double, descriptor array<double>"
    ).repartition(4)


@pytest.mark.parametrize("params", [
    infinity.InfinityParams(1.0, 30.0, 0.8, 2), infinity.InfinityParams(1.0, 30.0, 0.8, 4), infinity.InfinityParams(25.0, 300.0, 0.99, 2),
])
def test_tracks(spark, params):
    rows = scene(np.random.default_rng(1), 25, 6)
    got = {tuple(r) for r in infinity.infinity_tracks(frame(spark, rows), params).collect()}
    assert got == plain(rows, params) and got


def test_far_and_near_points(spark):
    """Cameras ten apart: a point at 20 is finite, one at a million is at infinity."""
    centers = [(i, 10.0 * i, 0.0, 0.0) for i in range(4)]
    rows = []
    for k, p in enumerate(np.array([[5.0, 3.0, 20.0], [2e5, 3e5, 1e6]])):
        for i, *c in centers:
            d = p - np.array(c)
            rows.append((4 * k + i, i, d / np.linalg.norm(d), np.full(8, 50.0 * k)))
    from pyspark.sql import functions as F

    feats = frame(spark, rows).withColumn("sigma", F.lit(1e-3))
    found = infinity.find_infinity_points(
        feats, spark.createDataFrame(centers, "image_id long, cx double, cy double, cz double"), 100.0, infinity.InfinityParams(60.0, 10.0, 0.8, 2)
    )
    got = {r["track"]: r for r in found.collect()}
    assert got[0]["class"] == "finite" and [round(got[0][c], 6) for c in "xyz"] == [5.0, 3.0, 20.0] and got[0]["w"] == 1.0
    assert got[4]["class"] == "infinity" and got[4]["w"] == 0.0
    assert infinity.infinity_tracks(feats.filter("false")).count() == 0


def test_radius_join_with_a_hot_cell(spark):
    """A third of both sides in one cell, cut into blocks of 20."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, (300, 2))
    x[:100] = 5 + 0.01 * rng.normal(size=(100, 2))
    x[100:110] = x[0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double").repartition(4)
    q = df.select(*[df[c].alias(f"q{c}") for c in df.columns])
    got = knn.within_radius(q, df, 0.7, ["qx", "qy"], ["x", "y"], block=20)
    pairs = [(r["qid"], r["id"]) for r in got.collect()]
    want = {(i, j) for i, j in itertools.product(range(300), repeat=2) if math.dist(x[i], x[j]) <= 0.7}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_radius_join_copies_few_rows(spark, monkeypatch):
    """Three queries beside 4,000 corpus rows of a cell are not copied to each 64 of them, and partitions follow the rows."""
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 0.7, (4000, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    q = df.filter("id < 3").select(*[df[c].alias(f"q{c}") for c in df.columns])
    monkeypatch.setattr(skew, "PART_ROWS", 100)
    seen = []
    real = type(df).join
    monkeypatch.setattr(type(df), "join", lambda a, b, *how: seen.append((a, b)) or real(a, b, *how))
    got = knn.within_radius(q, df, 0.3, ["qx", "qy"], ["x", "y"], block=64)
    monkeypatch.undo()
    left, right = seen[-1]
    assert left.count() + right.count() <= 4000 + 2 * 27
    assert got.rdd.getNumPartitions() >= 40
    want = {(i, j) for i in range(3) for j in range(4000) if math.dist(x[i], x[j]) <= 0.3}
    assert sorted((r["qid"], r["id"]) for r in got.collect()) == sorted(want)


def test_blocks_send_two_rows_an_image(spark):
    """Copies of one feature and close directions in blocks of 16: the same two nearest, and no pairs beyond them."""
    rows = scene(np.random.default_rng(3), 20, 5)
    hot = rows[0]
    rows += [(1000 + k, k % 5, hot[2], hot[3] + (k % 3)) for k in range(60)]
    p = infinity.InfinityParams(30.0, 250.0, 0.9, 2)
    block = 16
    got = infinity._two_nearest(frame(spark, rows), p, block).collect()
    seen = {}
    for r in got:
        seen.setdefault((r["a"], r["image"]), set()).add((r["d2"], r["b"]))
    assert max(map(len, seen.values())) <= 2 * -(-len(rows) // block) and len(got) == sum(map(len, seen.values()))
    chord = math.sqrt(2 * (1 - math.cos(math.radians(p.eps_deg))))
    for a in rows:
        for image in range(5):
            d2 = sorted((float(((a[3] - b[3]) ** 2).sum()), b[0]) for b in rows if b[1] == image != a[1] and np.linalg.norm(a[2] - b[2]) <= chord)
            if d2 and d2[0][0] < p.max_distance**2:
                want = [d for d in d2[:2] if d[0] < p.max_distance**2 / p.ratio**2]
                assert sorted(seen[a[0], image])[: len(want)] == want
    assert {tuple(r) for r in infinity.infinity_tracks(frame(spark, rows), p).collect()} == plain(rows, p)
