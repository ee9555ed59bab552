"""Bucketed search against exact neighbours."""

import numpy as np
import pytest

from manyview.operators import approx, knn


def rows(n, dim, clusters, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 3 + rng.normal(size=(n, dim))
    return x.round(3)


def found(spark, x, k, **params):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    out = knn.self_knn(df, k, "id", "vec", search=approx.bucketed(**params)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["row"], r["rank"])):
        got.setdefault(r["row"], []).append((r["nn"], r["dist"]))
    return got


def exact(x, k):
    out = {}
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out[i] = [(int(j), float(d[j])) for j in order]
    return out


def recall(got, want):
    hits = sum(len({n for n, _ in got.get(i, [])} & {n for n, _ in v}) for i, v in want.items())
    return hits / sum(len(v) for v in want.values())


def test_recall_and_exact_distances(spark):
    x = rows(3000, 24, 40, 1)
    got, want = found(spark, x, 8), exact(x, 8)
    assert recall(got, want) >= 0.95
    for i, v in got.items():
        assert v == sorted(v, key=lambda e: (e[1], e[0])) and len(v) == 8
        assert all(d == pytest.approx(np.linalg.norm(x[i] - x[n]), abs=1e-9) for n, d in v)


def test_more_checks_find_more(spark):
    x = rows(2000, 24, 1, 2)
    want = exact(x, 5)
    few, many = (recall(found(spark, x, 5, tables=2, bucket=50, checks=c), want) for c in (50, 1600))
    assert few < many and many >= 0.9


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    """A third of all rows in one place, a group of copies, and blocks of few rows."""
    monkeypatch.setattr(approx, "CELL_ROWS", 40)
    x = rows(600, 6, 10, 3)
    x[:200] = x[0] + 1e-3 * np.arange(200)[:, None]
    x[200:300] = x[200]
    got, want = found(spark, x, 4, tables=6, bucket=32, checks=256), exact(x, 4)
    assert recall(got, want) >= 0.95
    assert got[250] == want[250]


def test_few_rows(spark):
    assert found(spark, np.zeros((0, 3)), 3) == {}
    assert found(spark, np.array([[1.0, 2.0]]), 3) == {}
    assert found(spark, np.array([[0.0, 0.0], [3.0, 4.0]]), 3) == {0: [(1, 5.0)], 1: [(0, 5.0)]}
