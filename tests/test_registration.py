"""Multi-alignment order and rigid fragments against the sequential walks."""

import numpy as np
import pytest

from manyview.operators import registration as R


def _random_quats(rng, n):
    q = rng.normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def _sequential_sweeps(edges, reference):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, sweep = {reference: 0}, 0
    while True:
        sweep, before = sweep + 1, len(taken)
        for r in sorted(near):
            if r not in taken and near[r] & taken.keys():
                taken[r] = sweep
        if len(taken) == before:
            return taken


@pytest.mark.parametrize("seed", range(4))
def test_settle_order(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {tuple(sorted(e)) for e in rng.integers(0, 12, (13, 2)).tolist() if e[0] != e[1]} | {(3, 7)}
    both = [(a, b) for a, b in edges] + [(b, a) for a, b in edges]
    got = {r["recon"]: r["sweep"] for r in R.settle_order(spark.createDataFrame(both, "a long, b long"), 3).collect()}
    assert got == _sequential_sweeps(edges, 3)


def _fit(s, t):
    """The sums' solution over rows (q, c) computed directly."""
    rel = R._multiply(t[:, :4] * [1, -1, -1, -1], s[:, :4])
    q = np.linalg.eigh(rel.T @ rel)[1][:, 3]
    rot = R.rotations(q[None])[0]
    a, b = s[:, 4:] - s[:, 4:].mean(0), t[:, 4:] - t[:, 4:].mean(0)
    scale = ((a @ rot.T) * b).sum() / (a * a).sum() if len(s) > 1 else 1.0
    return q, scale, t[:, 4:].mean(0) - scale * rot @ s[:, 4:].mean(0)


def _errors(fit, s, t, scene):
    q, scale, o = fit
    off = np.linalg.norm(scale * s[:, 4:] @ R.rotations(q[None])[0].T + o - t[:, 4:], axis=1) / scene * 100
    same = np.abs(R._multiply(t[:, :4] * [1, -1, -1, -1], s[:, :4]) @ q)
    return off, np.degrees(2 * np.arccos(np.minimum(same, 1)))


def _walk(s, t, scene, limits):
    left, parts = np.arange(len(s)), []
    while len(left) >= max(2, limits.min_size):
        best = None
        for i, a in enumerate(left):
            for b in left[i + 1 :]:
                fit = _fit(s[[a, b]], t[[a, b]])
                if fit[1] <= 0:
                    continue
                off, turn = _errors(fit, s[left], t[left], scene)
                inside = left[(off < limits.position) & (turn < limits.rotation)]
                if best is None or len(inside) > len(best):
                    best = inside
        if best is None or len(best) < limits.min_size:
            break
        for _ in range(limits.rounds):
            fit = _fit(s[best], t[best])
            off, turn = _errors(fit, s[left], t[left], scene)
            inside = left[(off < limits.position) & (turn < limits.rotation)]
            if fit[1] <= 0 or len(inside) < limits.min_size:
                break
            same, best = np.array_equal(inside, best), inside
            if same:
                break
        parts.append(set(best.tolist()))
        left = np.setdiff1d(left, best)
    return parts, set(left.tolist())


def _scene(seed):
    rng = np.random.default_rng(seed)
    n = 30
    s = np.column_stack((_random_quats(rng, n), rng.uniform(-5, 5, (n, 3))))
    t = np.empty_like(s)
    for rows, scale in ((slice(0, 14), 1.3), (slice(14, 23), 0.7), (slice(23, 30), None)):
        own = s[rows]
        if scale is None:
            t[rows] = np.column_stack((_random_quats(rng, len(own)), rng.uniform(-50, 50, (len(own), 3))))
            continue
        f = _random_quats(rng, 1)
        t[rows, :4] = R._multiply(own[:, :4], np.repeat(f * [1, -1, -1, -1], len(own), 0))
        t[rows, 4:] = scale * own[:, 4:] @ R.rotations(f)[0].T + rng.uniform(-20, 20, 3) + 0.02 * rng.normal(size=(len(own), 3))
    return s, t


@pytest.mark.parametrize("seed", range(2))
def test_fragments(spark, seed):
    s, t = _scene(seed)
    limits = R.FragmentLimits(min_size=4)
    df = spark.createDataFrame([(i, *a.tolist(), *b.tolist()) for i, (a, b) in enumerate(zip(s, t))], ["id", *R._NUMBERS]).repartition(3)
    got = R.rigid_fragments(df, 10.0, limits).collect()
    parts, rest = _walk(s, t, 10.0, limits)
    by = {}
    for r in got:
        by.setdefault(r["component"], set()).add(r["id"])
    assert by.pop(None, set()) == rest
    assert [by[k] for k in sorted(by)] == parts == [set(range(14)), set(range(14, 23))]
    first = _fit(s[sorted(parts[0])], t[sorted(parts[0])])
    off, turn = _errors(first, s, t, 10.0)
    for r in got:
        if r["component"] in (None, 1):
            assert r["position_error"] == pytest.approx(off[r["id"]], abs=1e-6) and r["rotation_error"] == pytest.approx(turn[r["id"]], abs=1e-4)


def test_no_fragment(spark):
    s, t = _scene(5)
    rows = [(i, *a.tolist(), *b.tolist()) for i, (a, b) in enumerate(zip(s[23:], t[23:]))]
    got = R.rigid_fragments(spark.createDataFrame(rows, ["id", *R._NUMBERS]), 10.0).collect()
    assert len(got) == 7 and all(r["component"] is None and r["position_error"] is None for r in got)


def test_too_few_points(spark):
    rows = [(i, 1.0 * i, 2.0 * i * i, 0.5, 1.0 * i, 2.0 * i * i, 0.5) for i in range(9)]
    df = spark.createDataFrame(rows, ["pair_id", "sx", "sy", "sz", "tx", "ty", "tz"])
    with pytest.raises(ValueError):
        R.fit_by_points(df)
    fit, n, inliers = R.fit_by_points(df, min_points=9)
    assert (n, inliers) == (9, 9) and fit.scale == pytest.approx(1.0)
