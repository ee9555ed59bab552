"""Hot keys: results stay whole and equal brute force."""

import itertools
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from manyview.operators import align, clusters, filters, graph, knn, matching, motion, pairs, skew


def test_self_pairs_of_a_hot_group(spark):
    rows = [(0, i) for i in range(300)] + [(g, i) for g in range(1, 20) for i in range(3)]
    df = spark.createDataFrame(rows, "g long, item long")
    got = skew.self_pairs(df, ["g"], "item", block=32)
    want = {(0, a, b) for a, b in itertools.combinations(range(300), 2)} | {
        (g, a, b) for g in range(1, 20) for a, b in itertools.combinations(range(3), 2)
    }
    out = [(r["g"], r["a_item"], r["b_item"]) for r in got.collect()]
    assert len(out) == len(want) and set(out) == want


def test_global_rank_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, 2]), float(rng.randint(0, 50)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, v double, id long")
    for k, pos, n in skew.global_rank(df, ["v", "id"], ["k"]).groupBy("k").agg(F.max("pos"), F.count("*")).collect():
        assert pos == n - 1
    got = {r["k"]: (r["a"], r["b"]) for r in skew.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    for k in range(3):
        vals = [v for kk, v, _ in rows if kk == k]
        assert np.allclose(got[k], np.percentile(vals, [50, 90]))


def test_halo_windows_equal_whole_windows(spark):
    rng = np.random.default_rng(5)
    n = 500
    v = rng.random(n) + 0.1
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "seq long, pos long, step double")
    chunk = skew.CHUNK
    try:
        skew.halo_chunks.__defaults__ = (64,)
        got = {r["pos"]: r["step_ratio"] for r in motion.step_ratios(df).collect()}
    finally:
        skew.halo_chunks.__defaults__ = (chunk,)
    for i in range(n):
        pre, post = v[max(0, i - 7) : i], v[i + 1 : i + 8]
        if len(pre) < 2 or len(post) < 2:
            assert got[i] is None
        else:
            a, b = statistics.median(pre), statistics.median(post)
            assert abs(got[i] - max(a / b, b / a)) < 1e-9


def _brute(q, c, k):
    d = np.sqrt(((q[:, None, :] - c[None, :, :]) ** 2).sum(-1))
    return [sorted((round(d[i, j], 9), j) for j in range(len(c)))[:k] for i in range(len(q))]


def test_knn_boxes_and_pivots(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF_ROWS", 64)
    monkeypatch.setattr(knn, "CELL_ROWS", 100)
    rng = np.random.default_rng(7)
    for dim in (3, 16):
        x = rng.normal(size=(700, dim))
        x[:230] = x[0]  # a third are copies
        df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
        got = {}
        for r in knn.self_knn(df, 4, "id", "v", include_self=True).collect():
            got.setdefault(r["row"], []).append((round(r["dist"], 9), r["nn"]))
        assert {i: sorted(v) for i, v in got.items()} == dict(enumerate(_brute(x, x, 4)))


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[i] == 1000 for i in range(1000, 1061))


def test_greedy_assignment_is_the_sequential_one(spark):
    rng = random.Random(2)
    votes = {(rng.randint(0, 30), rng.randint(0, 30)): rng.randint(1, 4) for _ in range(200)}
    df = spark.createDataFrame([(s, t, v) for (s, t), v in votes.items()], "source_point long, target_point long, votes long")
    used_s, used_t, want = set(), set(), set()
    for (s, t), v in sorted(votes.items(), key=lambda e: (-e[1], e[0])):
        if s not in used_s and t not in used_t:
            used_s.add(s), used_t.add(t), want.add((s, t, v))
    assert {tuple(r) for r in matching.greedy_one_to_one(df).collect()} == want


def test_claimed_clusters_are_the_sequential_ones(spark):
    rng = random.Random(4)
    n = 60
    image = {i: rng.randint(0, 5) for i in range(n)}
    cand = {}
    for s in range(n):
        for c in rng.sample(range(n), rng.randint(0, 5)):
            if image[c] != image[s]:
                cand[(s, c)] = float(rng.randint(1, 4))
    rows = spark.createDataFrame(list(image.items()), "row_id long, image_id long")
    cd = spark.createDataFrame([(s, c, d, image[s], image[c]) for (s, c), d in cand.items()], "seed long, cand long, dist double, seed_image long, cand_image long")
    count = {s: sum(1 for a, _ in cand if a == s) for s in range(n)}
    claimed, want = set(), set()
    for s in sorted(range(n), key=lambda r: (-count[r], r)):
        if s in claimed:
            continue
        best = {}
        for (a, c), d in cand.items():
            if a == s and c not in claimed:
                best[image[c]] = min(best.get(image[c], (9e9, 0)), (d, c))
        claimed.add(s)
        if best:
            want.add((s, s))
            for _, c in best.values():
                claimed.add(c)
                want.add((s, c))
    got = {(r["cluster_id"], r["row_id"]) for r in clusters.claim_clusters(rows, cd).collect()}
    assert got == want


def test_thinning_is_the_sequential_sweep(spark):
    rng = random.Random(9)
    n = 40
    shared = {(i, j): rng.randint(1, 30) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3}
    order = list(range(n))
    rng.shuffle(order)
    tau, kept = 16.0, []
    for i in order:
        best = max((shared.get((min(i, k), max(i, k)), 0) for k in kept), default=None)
        if best is None or tau / 8 <= best < tau:
            kept.append(i)
    p = spark.createDataFrame([(i, j, c) for (i, j), c in shared.items()], "i long, j long, shared long")
    o = spark.createDataFrame([(im, r) for r, im in enumerate(order)], "image_id long, rank long")
    assert {r["image_id"] for r in pairs.thin(p, o, tau).collect()} == set(kept)


def test_widest_angle_of_a_heavy_track(spark):
    rng = np.random.default_rng(11)
    d = rng.normal(size=(400, 3)) * [0.3, 0.3, 0.05] + [0, 0, 1]
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    rows = [(0, i, *map(float, r)) for i, r in enumerate(d)] + [(1, i, *map(float, r)) for i, r in enumerate(d[:5])]
    df = spark.createDataFrame(rows, "point_id long, image_id long, dx double, dy double, dz double")
    got = {r["point_id"]: r["max_angle"] for r in filters.max_viewing_angles(df).collect()}
    for p, m in ((0, d), (1, d[:5])):
        assert abs(got[p] - np.arccos(np.clip(m @ m.T, -1, 1)).max()) < 1e-9


def test_seed_groups_of_large_parts(spark, monkeypatch):
    """Rounds over a part of any size reach what the walk over it reaches."""
    rng = random.Random(7)
    rows = {(i, j): rng.randint(1, 30) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.12 or j - i < 3}
    df = spark.createDataFrame([(i, j, s) for (i, j), s in rows.items()], "i long, j long, shared long")
    walked = sorted(map(tuple, pairs.seed_groups(df, group_size=4, min_shared=5).collect()))
    monkeypatch.setattr(pairs, "LOCAL_PAIRS", 12)
    assert sorted(map(tuple, pairs.seed_groups(df, group_size=4, min_shared=5).collect())) == walked
    assert len({m for _, m in walked}) == len(walked)


def test_covisibility_rows_are_not_sorted_by_group(spark, monkeypatch):
    """Neither the making distinct nor the look-up of heavy groups holds rows in partitions whose number doesn't follow them."""
    from manyview.plans import graphs

    given = []
    real = pairs.shared_counts
    monkeypatch.setattr(pairs, "shared_counts", lambda rows, group: given.append(rows) or real(rows, group))
    graphs.seed_groups(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in given[0]._jdf.queryExecution().executedPlan().toString()

    rng = random.Random(4)
    rows = [(0 if k < 90 else k % 30, rng.randrange(40)) for k in range(270)]
    df = spark.createDataFrame(rows, "point_id long, image_id long").distinct()
    monkeypatch.setattr(skew, "PART_ROWS", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = skew.self_pairs(df, ["point_id"], "image_id", block=10, parts=skew.pair_parts(df, ["point_id"], 10))
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["point_id"], r["a_image_id"], r["b_image_id"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftOuter" in x]
    assert found == sorted((p, a, b) for p, a in set(rows) for q, b in set(rows) if p == q and a < b)


def test_ransac_without_a_hypothesis(spark):
    same = [(i, 1.0, 1.0, 1.0, float(i), 0.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(same, "pair_id long, sx double, sy double, sz double, tx double, ty double, tz double")
    _, inliers = align.ransac_similarity(df, 0.1, iterations=4)
    assert inliers == 4


def test_classes_of_tracks(spark):
    """Parallel rays over a wide base are at infinity, over a short one open, crossing ones finite."""
    from manyview.operators import triangulation

    def ray(track, c, p):
        d = np.array(p, float) - c
        d /= np.linalg.norm(d)
        return (track, *map(float, d), *map(float, c), 1e-3)

    rows = [ray(1, np.array([x, 0, 0.0]), (0, 0, 10)) for x in (-1.0, 0.0, 1.0)]
    rows += [(2, 0.0, 0.0, 1.0, x, 0.0, 0.0, 1e-3) for x in (-5.0, 0.0, 5.0)]
    rows += [(3, 0.0, 0.0, 1.0, x, 0.0, 0.0, 1e-3) for x in (-0.001, 0.001)]
    rows += [ray(4, np.array([x, 0, 0.0]), (0, 0, -1e6)) for x in (-5.0, 5.0)]
    rows += [(5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1e-3)]
    df = spark.createDataFrame(rows, "track long, dx double, dy double, dz double, cx double, cy double, cz double, sigma double")
    got = {r["track"]: r for r in triangulation.classify_infinity(df, horizon=100.0).collect()}
    assert {t: r["class"] for t, r in got.items()} == {1: "finite", 2: "infinity", 3: "indeterminate", 4: "infinity"}
    assert got[2]["w"] == 0.0 and np.allclose([got[2][a] for a in "xyz"], [0, 0, 1])
    assert np.allclose([got[1][a] for a in "xyz"], [0, 0, 10])


def test_thin_to_a_target(spark):
    rng = random.Random(3)
    rows = [(i, j, rng.randint(1, 40)) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "i long, j long, shared long")
    order = spark.createDataFrame([(i, i) for i in range(30)], "image_id long, rank long")
    kept = {r["image_id"] for r in pairs.thin_to(df, order, 8, iterations=4).collect()}
    assert 0 in kept and 1 <= len(kept) <= 30


def test_coordinate_votes_visit_few_tiles(spark):
    """Votes across tile borders as by all pairs, and a source keypoint visits fewer than three tiles on average instead of nine cells."""
    rng = random.Random(12)
    at = [(1, k, rng.uniform(-60, 160), rng.uniform(-60, 160)) for k in range(150)] + [(1, 900, 40.0, 0.0), (1, 901, -40.0, 40.0)]
    to = [(i, k, x + rng.uniform(-6, 6), y + rng.uniform(-6, 6)) for i, k, x, y in at[:-2]] + [(1, 900, 50.0, 0.0), (1, 901, -40.0, 30.0)]
    schema = "image_id long, point_id long, x double, y double"
    src, tgt = spark.createDataFrame(at, schema), spark.createDataFrame(to, schema)
    d2 = {(a[1], b[1]): (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 for a in at for b in to if (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 100.0}
    best = lambda side: {k: min((d, p[1 - side]) for p, d in d2.items() if p[side] == k)[1] for k in {p[side] for p in d2}}
    of_s, of_t = best(0), best(1)
    got = matching.mutual_coordinate_votes(src, tgt, 10.0, 1)
    assert {(r["source_point"], r["target_point"]) for r in got.collect()} == {(s, t) for s, t in of_s.items() if of_t[t] == s}
    seen = []
    real = matching.F.explode
    matching.F.explode = lambda c: seen.append(c) or real(c)
    try:
        matching.mutual_coordinate_votes(src, tgt, 10.0, 1)
    finally:
        matching.F.explode = real
    n = src
    for k, c in enumerate(seen[:2]):
        n = n.withColumnRenamed("x", "sx").withColumnRenamed("y", "sy").withColumn(f"g{k}", real(c))
    assert n.count() < 3 * len(at)


def test_vectors_are_shipped_in_bounded_parts():
    """A vector that visits every cell doesn't make one large batch."""
    import pandas as pd

    b = pd.DataFrame({"rep": range(100), "vec": [np.full(9, float(k)) for k in range(100)]})
    row, cell = np.nonzero(np.ones((100, 300), dtype=bool))
    parts = list(knn._to_cells(b, "rep", row, cell, "crep"))
    assert max(map(len, parts)) <= knn.SHIP_ROWS and sum(map(len, parts)) == 30000
    whole = pd.concat(parts)
    assert whole["crep"].tolist() == row.tolist() and whole["cell"].tolist() == cell.tolist() and all(v[0] == k for v, k in zip(whole["vec"], whole["crep"]))
    assert [len(p) for p in knn._parts([b, b.iloc[:0]])] == [100]
