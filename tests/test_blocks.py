"""Search in many dimensions: blocks are written once and met in pairs, no vector is shuffled for each cell it matters to."""

import numpy as np
import pytest

from manyview.operators import clusters, knn


def vectors(seed, n, dim=12):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[: n // 3] = x[0]
    x[n // 3 : n // 2] += 1000  # far off, so that blocks are left out
    return x


def frame(spark, x, kind, name=lambda i: i):
    rows = [(name(i), [float(a) for a in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id {'string' if isinstance(name(0), str) else 'long'}, v array<{kind}>").repartition(3)


def nearest(q, c, k, name=lambda i: i):
    d = np.sqrt(((q[:, None, :].astype(float) - c[None, :, :].astype(float)) ** 2).sum(-1))
    return {name(i): sorted((round(d[i, j], 9), name(j)) for j in range(len(c)))[:k] for i in range(len(q))}


def lists(out, row, nn):
    got = {}
    for r in sorted(out.collect(), key=lambda r: (str(r[row]), r["rank"])):
        got.setdefault(r[row], []).append((round(r["dist"], 9), r[nn]))
    return got


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 50)
    monkeypatch.setattr(knn, "QUERY_STEP", 16)
    monkeypatch.setattr(knn, "PAIR_STEP", 64)
    monkeypatch.setattr(knn, "HELD_BYTES", 4000)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_of_one_table(spark, small, kind):
    x = vectors(3, 400)
    out = knn.self_knn(frame(spark, x, kind), 5, "id", "v", include_self=True)
    assert "CartesianProduct" in (plan := out._jdf.queryExecution().executedPlan().toString())
    assert not [line for line in plan.splitlines() if "Exchange" in line and "cell" in line]
    assert lists(out, "row", "nn") == nearest(x, x, 5)


def test_blocks_of_two_tables_and_names(spark, small):
    name = lambda i: f"n{i:04d}"
    q, c = vectors(5, 160), vectors(6, 300)
    out = knn.knn_join(frame(spark, q, "float", name), frame(spark, c, "double", name).toDF("cid", "v"), 4, "id", "cid", "v", "v")
    assert lists(out, "id", "cid") == nearest(q, c, 4, name)


def test_tiny_and_huge_vectors(spark, small):
    for scale in (1e-30, 1e25):
        x = np.random.default_rng(8).normal(size=(200, 9)) * scale
        got = lists(knn.self_knn(frame(spark, x, "double"), 3, "id", "v"), "row", "nn")
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        assert {i: [j for _, j in v] for i, v in got.items()} == {i: [int(j) for j in np.argsort(r)[:3]] for i, r in enumerate(d)}


def test_floor_searches_once(spark, monkeypatch):
    x = vectors(9, 90)
    df = frame(spark, x, "float").selectExpr("id AS row_id", "id % 7 AS image_id", "v AS descriptor")
    out = clusters.floor_candidates(df, d=6, alpha=0.9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1
    want = set()
    for i, found in nearest(x, x, 7).items():
        want |= {(i, j) for d, j in found if j != i and j % 7 != i % 7 and d <= round(0.9 * found[6][0], 9)}
    assert {(r["seed"], r["cand"]) for r in out.collect()} == want


def test_buckets_compare_what_they_hold(spark, small, monkeypatch):
    """Blocks and parts of any size compare a query with the rows of its buckets in all tables, each once, and no vector is copied for a table."""
    from manyview.operators import approx

    monkeypatch.setattr(approx, "CELL_ROWS", 60)
    x = np.random.default_rng(4).normal(size=(500, 10))
    x[:150] = x[0] + np.random.default_rng(5).random((150, 1))
    df = frame(spark, x, "double")
    out = knn.self_knn(df, 6, "id", "v", include_self=True, search=approx.bucketed(tables=3, bucket=16, checks=64))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    c = df.selectExpr("id AS rep", "v AS vec")
    planes = approx._planes(knn._sample(c, approx.SAMPLE), 3, int(np.ceil(np.log2(500 / 16))), 7)
    probes = [(approx.codes(x, p, 4), approx.codes(x, p, 1)[:, 0]) for p in planes]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in range(len(x)):
        met = np.any([np.isin(held, asked[i]) for asked, held in probes], axis=0)
        want[i] = sorted((round(d[i, j], 9), int(j)) for j in np.flatnonzero(met))[:6]
    assert lists(out, "row", "nn") == want
