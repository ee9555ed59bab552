"""Points merged along groups and shared observations, by brute force; the observations are read and dealt once."""

import random

from manyview.operators import merge
from manyview.plans import graphs


def brute(points, obs, groups):
    part = {k: groups.get(k, k) for k in points}
    seen = {(part[k], i, f) for k, i, f in obs if k in points}
    root = {p: p for p in part.values()}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    at = {}
    for p, i, f in sorted(seen, key=lambda e: (e[0], str(e[1:]))):
        if i is not None and f is not None:
            a, b = sorted((top(p), top(at.setdefault((i, f), p))))
            root[b] = a
    means = {p: [sum(points[k][c] for k in part if part[k] == p) / sum(1 for k in part if part[k] == p) for c in range(7)] for p in set(part.values())}
    merged = {}
    for r in {top(p) for p in means}:
        own = [m for p, m in means.items() if top(p) == r]
        merged[r] = [sum(m[c] for m in own) / len(own) for c in range(7)] + [len(own)]
    return merged, {(top(p), i, f) for p, i, f in seen}


def test_merge_of_points_and_tracks(spark):
    rng = random.Random(5)
    points = {k: [rng.uniform(-5, 5) for _ in range(3)] + [float(rng.randint(0, 255)) for _ in range(3)] + [rng.random()] for k in range(120)}
    obs = [(rng.randint(0, 139), rng.randint(0, 9), rng.randint(0, 60)) for _ in range(260)]
    obs += obs[:40] + [(k, 50, 7) for k in range(60, 72)] + [(3, None, 1), (4, None, 1), (5, 2, None)]
    groups = {k: rng.randint(0, 125) for k in rng.sample(range(130), 25)}
    p = spark.createDataFrame([(k, *v) for k, v in points.items()], "key long, x double, y double, z double, r double, g double, b double, error double")
    o = spark.createDataFrame(obs, "key long, image_id long, feature_index long").repartition(4)
    g = spark.createDataFrame(list(groups.items()), "key long, group_key long")
    merged, tracks = merge.merge_points_and_tracks(p, o, g)
    want, want_tracks = brute(points, obs, groups)
    got = {r["root"]: r for r in merged.collect()}
    assert set(got) == set(want)
    for root, v in want.items():
        r = got[root]
        assert all(abs(r[c] - v[n]) < 1e-9 for c, n in (("x", 0), ("y", 1), ("z", 2), ("error", 6))) and r["n_parts"] == v[7]
        assert all(r[c] == int(round(v[n], 6) + 0.5) for c, n in (("r", 3), ("g", 4), ("b", 5)))
    found = [tuple(r) for r in tracks.collect()]
    assert len(found) == len(want_tracks) and set(found) == want_tracks
    merged, tracks = merge.merge_points_and_tracks(p, o.filter("false"), g.filter("false"))
    assert merged.count() == len(points) and tracks.count() == 0


def test_observations_are_read_once(spark):
    plan = graphs.merge_points_and_tracks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
