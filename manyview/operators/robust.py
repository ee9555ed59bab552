"""Robust two-view models of all image pairs at once.

1. Every pair's ``SAMPLE`` matches of smallest hash propose: minimal sets drawn from them
   give hypotheses, and the few that most of the sample agrees with are kept. This is the
   only step that holds rows of a pair together, and it holds no more than the sample.
2. All matches score the kept hypotheses in one join and one count per pair.
3. The best is refitted to the matches that agree with it, from sums, as long as their number
   grows. All pairs take a round together; a pair that stops growing keeps its model.

matches (pair, x, y, u, v): pixels in the first and the second image. Rows with a null or
non-finite number take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .twoview import SYM, _full, _homography, _outer, _scaling

SAMPLE = 64
#: Hypotheses that every match scores.
KEPT = 4
MODEL = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class Limits:
    """Pixels a match may be off, draws per pair, refits, matches that have to agree, seed of the draws."""

    max_error: float = 3.0
    draws: int = 512
    rounds: int = 10
    min_inliers: int = 12
    seed: int = 0


@dataclass(frozen=True)
class Model:
    """``size`` matches make a hypothesis by ``propose`` ((draws, size, 4) to (draws, 9)); ``error`` is the
    squared error of a match under ``m``; ``refit`` solves (sums, norms) of ``terms``."""

    size: int
    propose: Callable[[np.ndarray], np.ndarray]
    error: Callable[[Column, Column, Column, Column, Column], Column]
    error_of: Callable[[np.ndarray, np.ndarray], np.ndarray]
    terms: Callable[[Column, Column, Column, Column], list[Column]]
    refit: Callable


def estimate(matches: DataFrame, model: Model, limits: Limits = Limits()) -> DataFrame:
    """(pair, n, inliers, model): row-major 3 x 3 up to scale; pairs with fewer than ``min_inliers`` have no row."""
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y", "u", "v")]
    m = cut(matches.select("pair", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]).filter(fine[0] & fine[1] & fine[2] & fine[3]))
    bound = limits.max_error**2
    xy = [F.col(c) for c in ("x", "y", "u", "v")]
    # Hypotheses side by side: a match is joined once, and counts need no sort.
    side = [f"i{k}" for k in range(KEPT)]
    agrees = [F.sum((model.error(F.get("ms", F.lit(k)), *xy) <= bound).cast("long")).alias(i) for k, i in enumerate(side)]
    proposed = cut(_proposals(m, model, limits).groupBy("pair").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("ms")))
    scored = m.join(proposed, "pair").groupBy("pair").agg(F.count(F.lit(1)).alias("n"), *agrees)
    # The most matches, then the first hypothesis; a hypothesis that a pair lacks counts none.
    first = F.array_position(F.array(*[F.coalesce(i, F.lit(-1)) for i in side]), F.greatest(*[F.coalesce(i, F.lit(-1)) for i in side]))
    best = cut(
        scored.withColumn("_b", first.cast("int")).join(proposed, "pair")
        .select("pair", "n", F.get(F.array(*side), F.col("_b") - 1).alias("inliers"), F.get("ms", F.col("_b") - 1).alias("m"))
    )
    live = cut(_agreeing(m, best.select("pair", "m"), model, bound))
    for _ in range(limits.rounds):
        again = cut(_refit(m, live, model, bound))
        grown = _agreeing(m, again, model, bound)
        live = cut(grown.join(live.select("pair", F.col("inliers").alias("_i")), "pair").filter("inliers > _i").drop("_i"))
        if live.isEmpty():
            break
        better = live.select("pair", F.col("m").alias("_m"), F.col("inliers").alias("_i"))
        best = cut(best.join(better, "pair", "left").select("pair", "n", F.coalesce("_i", "inliers").alias("inliers"), F.coalesce("_m", "m").alias("m")))
    return best.filter(F.col("inliers") >= limits.min_inliers).select("pair", "n", "inliers", F.col("m").alias("model"))


def _agreeing(m: DataFrame, models: DataFrame, model: Model, bound: float) -> DataFrame:
    """(pair, m, inliers, mx, my, mu, mv): how many matches agree with each pair's model, and their mean."""
    cols = ("x", "y", "u", "v")
    near = model.error(F.col("m"), *[F.col(c) for c in cols]) <= bound
    # Counts and means apart from the model, which would have them sorted.
    found = m.join(models, "pair").groupBy("pair").agg(
        F.sum(near.cast("long")).alias("inliers"), *[F.avg(F.when(near, F.col(c))).alias(f"m{c}") for c in cols]
    )
    return found.join(models, "pair")


def _proposals(m: DataFrame, model: Model, limits: Limits) -> DataFrame:
    """(pair, k, m): up to ``KEPT`` hypotheses per pair."""
    cols = ("x", "y", "u", "v")
    w = Window.partitionBy("pair").orderBy(F.xxhash64(F.lit(limits.seed), *cols), *cols)
    sample = m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= SAMPLE)

    # Only functions go to the workers; the model also holds a UDF, which belongs to the session.
    size, hypotheses, error_of = model.size, model.propose, model.error_of
    draws = {}

    def propose(batches):
        for b in batches:
            out = {"pair": [], "k": [], "m": []}
            for pair, flat in zip(b["pair"], b["flat"]):
                rows = np.asarray(flat, np.float64).reshape(-1, 4)
                if len(rows) < size:
                    continue
                if len(rows) not in draws:
                    draws[len(rows)] = np.argsort(np.random.default_rng(limits.seed).random((limits.draws, len(rows))), axis=1)[:, :size]
                found = hypotheses(rows[draws[len(rows)]])
                found = found[np.isfinite(found).all(1)]
                agree = (error_of(found, rows) <= limits.max_error**2).sum(1)
                top = np.argsort(-agree, kind="stable")[:KEPT]
                out["pair"] += [pair] * len(top)
                out["k"] += range(len(top))
                out["m"] += list(found[top])
            yield pd.DataFrame(out)

    # No more than the sample's numbers a pair, many pairs to a call.
    in_order = F.sort_array(F.collect_list(F.struct("_r", F.array(*cols).alias("row"))))
    rows = sample.groupBy("pair").agg(F.flatten(F.transform(in_order, lambda e: e["row"])).alias("flat"))
    kind = m.schema["pair"].dataType.simpleString()
    return rows.mapInPandas(propose, f"pair {kind}, k int, m array<double>")


def _refit(m: DataFrame, live: DataFrame, model: Model, bound: float) -> DataFrame:
    """(pair, m) from all matches that agree, both images moved to mean zero and mean distance sqrt 2.

    The sums are taken about the means in one pass with the mean distances, and scaled afterwards:
    every term is a sum of monomials of one degree in either image.
    """
    cols = ("x", "y", "u", "v")
    enough = live.filter(F.col("inliers") >= max(model.size, 4))
    inside = m.join(enough.drop("inliers"), "pair").filter(model.error(F.col("m"), *[F.col(c) for c in cols]) <= bound)
    at = inside.select("pair", *[(F.col(c) - F.col(f"m{c}")).alias(t) for c, t in zip(cols, "abcd")])
    terms = model.terms(*(F.col(c) for c in "abcd"))
    off = lambda a, b: F.avg(F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b)))
    names = [f"s{k}" for k in range(len(terms))]
    sums = at.groupBy("pair").agg(off("a", "b").alias("d1"), off("c", "d").alias("d2"), *[F.sum(t).alias(n) for n, t in zip(names, terms)])
    root = F.sqrt(F.lit(2.0))
    scaled = sums.filter("d1 >= 1e-12 AND d2 >= 1e-12").withColumns({"k1": root / F.col("d1"), "k2": root / F.col("d2")})
    one, k1, k2 = F.lit(1.0), F.col("k1"), F.col("k2")
    grow = [g / h for g, h in zip(model.terms(k1, k1, k2, k2), model.terms(one, one, one, one))]
    normal = scaled.select("pair", "k1", "k2", F.array(*[F.col(n) * g for n, g in zip(names, grow)]).alias("sums"))
    fitted = normal.join(enough.drop("m", "inliers"), "pair").select("pair", model.refit("sums", F.array("mx", "my", "k1", "mu", "mv", "k2")).alias("m"))
    return fitted.filter(F.forall("m", lambda x: ~F.isnan(x)))


def _homogeneous(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((*x.shape[:-1], 1))), axis=-1)


def _normalized(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(draws, size, 2) moved to mean zero and mean distance sqrt 2, and the matrices that did it."""
    mean = points.mean(1)
    d = np.linalg.norm(points - mean[:, None], axis=2).mean(1)
    k = np.sqrt(2.0) / np.where(d > 1e-12, d, np.nan)
    t = _scaling(np.column_stack((mean, k)))
    return (points - mean[:, None]) * k[:, None, None], t


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.reshape(-1, 9)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 1e-300, size, np.nan)


def _rank_two(f: np.ndarray) -> np.ndarray:
    u, d, vt = np.linalg.svd(f)
    d[:, 2] = 0.0
    return (u * d[:, None, :]) @ vt


def _null_of(a: np.ndarray) -> np.ndarray:
    fine = np.isfinite(a).all((1, 2))
    out = np.full((len(a), 3, 3), np.nan)
    if fine.any():
        # What is orthogonal to all rows; a tenth of the work of singular values.
        out[fine] = np.linalg.qr(a[fine].transpose(0, 2, 1), mode="complete")[0][:, :, -1].reshape(-1, 3, 3)
    return out


def _propose_fundamental(rows: np.ndarray) -> np.ndarray:
    a, t1 = _normalized(rows[:, :, :2])
    b, t2 = _normalized(rows[:, :, 2:])
    design = (_homogeneous(b)[..., :, None] * _homogeneous(a)[..., None, :]).reshape(*rows.shape[:2], 9)
    f = _null_of(design)
    fine = np.isfinite(f).all((1, 2))
    f[fine] = t2[fine].transpose(0, 2, 1) @ _rank_two(f[fine]) @ t1[fine]
    return _unit(f)


def _sampson_of(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(models, rows) squared first-order distances to the epipolar constraint."""
    x, y, u, v = rows.T
    f = models.T[:, :, None]
    line = [f[3 * r] * x + f[3 * r + 1] * y + f[3 * r + 2] for r in range(3)]
    back = [f[c] * u + f[3 + c] * v + f[6 + c] for c in range(2)]
    size = line[0] ** 2 + line[1] ** 2 + back[0] ** 2 + back[1] ** 2
    value = (u * line[0] + v * line[1] + line[2]) ** 2
    return np.where(size > 1e-300, value / np.where(size > 1e-300, size, 1.0), np.inf)


def sampson(m: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    f = [F.element_at(m, k) for k in range(1, 10)]
    line = [f[3 * r] * x + f[3 * r + 1] * y + f[3 * r + 2] for r in range(3)]
    back = [f[c] * u + f[3 + c] * v + f[6 + c] for c in range(2)]
    value = u * line[0] + v * line[1] + line[2]
    size = line[0] * line[0] + line[1] * line[1] + back[0] * back[0] + back[1] * back[1]
    return F.when(size > 1e-300, value * value / size).otherwise(float("inf"))


def _fundamental_terms(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """The 36 distinct entries of the linear system's normal matrix."""
    first, second = _outer((a, b, F.lit(1.0))), _outer((c, d, F.lit(1.0)))
    return [q * p for q in second for p in first]


@F.pandas_udf(MODEL)
def _refit_fundamental(sums: pd.Series, norms: pd.Series) -> pd.Series:
    s = np.stack(sums.to_numpy()).reshape(-1, 6, 6)
    m = np.zeros((len(s), 9, 9))
    for k, (i, j) in enumerate(SYM):
        block = _full(s[:, k])
        m[:, 3 * i : 3 * i + 3, 3 * j : 3 * j + 3] = block
        m[:, 3 * j : 3 * j + 3, 3 * i : 3 * i + 3] = block
    f = _rank_two(np.linalg.eigh(m)[1][:, :, 0].reshape(-1, 3, 3))
    n = np.stack(norms.to_numpy())
    return pd.Series(list(_unit(_scaling(n[:, 3:6]).transpose(0, 2, 1) @ f @ _scaling(n[:, 0:3]))))


#: q^T F p = 0, from eight matches; error: Sampson distance.
FUNDAMENTAL = Model(8, _propose_fundamental, sampson, _sampson_of, _fundamental_terms, _refit_fundamental)


def _propose_homography(rows: np.ndarray) -> np.ndarray:
    a, t1 = _normalized(rows[:, :, :2])
    b, t2 = _normalized(rows[:, :, 2:])
    p, q = _homogeneous(a), _homogeneous(b)
    (one, w1), (two, w2) = _corners(p), _corners(q)
    h = two @ _adjugate(one)
    # Four points in general position have one map, here in closed form; for others the linear system decides.
    flat = ~((w1 > 1e-4) & (w2 > 1e-4))
    if flat.any():
        p, b = p[flat], b[flat]
        zero = np.zeros_like(p)
        first = np.concatenate((p, zero, -b[..., :1] * p), axis=2)
        second = np.concatenate((zero, p, -b[..., 1:] * p), axis=2)
        h[flat] = _null_of(np.concatenate((first, second), axis=1))
    fine = np.isfinite(h).all((1, 2))
    h[fine] = np.linalg.inv(t2[fine]) @ h[fine] @ t1[fine]
    return _unit(h)


def _corners(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first three of four points, scaled so that they add up to a multiple of the fourth; the smallest volume of any three."""
    a, b, c, d = (p[:, k] for k in range(4))
    share = np.stack([_triple(d, b, c), _triple(a, d, c), _triple(a, b, d)], axis=1)
    least = np.minimum(np.abs(share).min(1), np.abs(_triple(a, b, c)))
    return (p[:, :3] * share[:, :, None]).transpose(0, 2, 1), least


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * np.cross(b, c)).sum(1)


def _adjugate(m: np.ndarray) -> np.ndarray:
    x, y, z = m[:, :, 0], m[:, :, 1], m[:, :, 2]
    return np.stack((np.cross(y, z), np.cross(z, x), np.cross(x, y)), axis=1)


def _transfer_of(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x, y = rows[:, 0], rows[:, 1]
    q = [h[0] * x + h[1] * y + h[2] for h in models.T[:, :, None].reshape(3, 3, -1, 1)]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        u, v = q[0] / q[2] - rows[:, 2], q[1] / q[2] - rows[:, 3]
        off = u * u + v * v
    off[np.isnan(off)] = np.inf
    return off


def transfer(m: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    h = [F.element_at(m, k) for k in range(1, 10)]
    w = h[6] * x + h[7] * y + h[8]
    du, dv = (h[0] * x + h[1] * y + h[2]) / w - u, (h[3] * x + h[4] * y + h[5]) / w - v
    return F.when(F.abs(w) > 1e-300, du * du + dv * dv).otherwise(float("inf"))


def _homography_terms(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    pp = _outer((a, b, F.lit(1.0)))
    return [*pp, *[c * e for e in pp], *[d * e for e in pp], *[(c * c + d * d) * e for e in pp]]


#: The second image's pixel is the first's under H, from four matches; error: distance in the second image.
HOMOGRAPHY = Model(4, _propose_homography, transfer, _transfer_of, _homography_terms, _homography)
