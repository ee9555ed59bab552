"""Near-duplicate classes against comparing all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from manyview.llm import near

from . import messy


def check(spark, data):
    out = near.near_classes(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    want = messy.classes(data)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    for r in out:
        assert r["n_shingles"] == len(messy.shingles(dict(data)[r["doc_id"]]))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def crowd(n, seed=3):
    """A hot group of near copies, half of them far from each other, exact copies, and many
    texts that share one passage."""
    rng = random.Random(seed)
    base = messy.sentence(rng, 100).split()
    passage = messy.sentence(rng, 40)
    data = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(40)}"
        data.append((i, " ".join(w)))
    data += [(n + i, messy.sentence(rng, 60) + " " + passage) for i in range(n // 3)]
    data += [(2 * n + i, data[i % 7][1]) for i in range(n // 3)]
    return data


def test_messy_rows(spark):
    docs = messy.docs(spark)
    out = near.near_classes(docs).collect()
    assert len(out) == len(messy.rows())
    want = messy.classes([(r[0], r[1]) for r in messy.rows() if r[0] is not None])
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
        else:
            assert r["kept"] and r["component_id"] is None
    kept = near.dedup_near(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c}) and ids.count(None) == 1
    assert near.near_classes(messy.empty(spark)).count() == 0


def test_hot_group(spark):
    check(spark, crowd(240))


def test_dense_regions_go_deeper(spark, monkeypatch):
    monkeypatch.setattr(near, "REGION", 24)
    monkeypatch.setattr(near, "BLOCK", 10)
    check(spark, crowd(120, seed=4))


def test_blocks_of_a_region(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    check(spark, crowd(90, seed=5))


def test_cell_links_are_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50)) for _ in range(40)] + [np.arange(30), np.arange(31), np.zeros(0, np.int64)]
    a, b = near._cell_links(pa.array([s.tolist() for s in sets], pa.list_(pa.int64())))
    link = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])) and len(sets[i])}
    got = {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True) if len(sets[x])}
    assert got <= link

    def parts(edges):
        root = list(range(len(sets)))
        for x, y in edges:
            root = [min(root[x], root[y]) if r in (root[x], root[y]) else r for r in root]
        return root

    assert parts(got) == parts(link)


def test_signatures_estimate_similarity():
    a = messy.sentence(random.Random(1), 2000)
    w = a.split()
    w[1000:1100] = ["z"] * 100
    h, at = near.shingle_sets(pa.array([a, " ".join(w)]))
    m = near.minima(h, at)
    x, y = messy.shingles(a), messy.shingles(" ".join(w))
    assert (m[0] == m[1]).mean() == pytest.approx(len(x & y) / len(x | y), abs=0.12)
