"""Linear two-view estimators from per-pair sums.

A direct linear fit only needs the entries of its normal matrix, and those are
sums of products over the correspondences. Each fit is therefore an ordinary
partial aggregate (24 sums for a homography, 36 for an essential matrix) and one
small eigenproblem per pair in an Arrow UDF, however many matches a pair has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V

SYM = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
NINE = T.ArrayType(T.DoubleType())


def _outer(p: V.Vec) -> list[Column]:
    return [p[i] * p[j] for i, j in SYM]


def _full(block: np.ndarray) -> np.ndarray:
    """(n, 6) upper entries to (n, 3, 3)."""
    m = np.empty((len(block), 3, 3))
    for k, (i, j) in enumerate(SYM):
        m[:, i, j] = block[:, k]
        m[:, j, i] = block[:, k]
    return m


@F.pandas_udf(NINE)
def _homography(sums: pd.Series, norms: pd.Series) -> pd.Series:
    s = np.stack(sums.to_numpy()).reshape(-1, 4, 6)
    a, b, c, d = (_full(s[:, k]) for k in range(4))
    m = np.zeros((len(s), 9, 9))
    m[:, 0:3, 0:3], m[:, 3:6, 3:6] = a, a
    m[:, 0:3, 6:9], m[:, 6:9, 0:3] = -b, -b
    m[:, 3:6, 6:9], m[:, 6:9, 3:6] = -c, -c
    m[:, 6:9, 6:9] = d
    h = np.linalg.eigh(m)[1][:, :, 0].reshape(-1, 3, 3)
    n = np.stack(norms.to_numpy())
    t1, t2 = _scaling(n[:, 0:3]), _scaling(n[:, 3:6])
    h = np.linalg.inv(t2) @ h @ t1
    h = h / np.where(np.abs(h[:, 2:3, 2:3]) < 1e-15, 1.0, h[:, 2:3, 2:3])
    return pd.Series(list(h.reshape(-1, 9)))


def _scaling(n: np.ndarray) -> np.ndarray:
    t = np.zeros((len(n), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = n[:, 2]
    t[:, 0, 2], t[:, 1, 2] = -n[:, 0] * n[:, 2], -n[:, 1] * n[:, 2]
    t[:, 2, 2] = 1.0
    return t


@F.pandas_udf(NINE)
def _essential(sums: pd.Series) -> pd.Series:
    s = np.stack(sums.to_numpy()).reshape(-1, 6, 6)
    m = np.zeros((len(s), 9, 9))
    for k, (i, j) in enumerate(SYM):
        block = _full(s[:, k])
        m[:, 3 * i : 3 * i + 3, 3 * j : 3 * j + 3] = block
        m[:, 3 * j : 3 * j + 3, 3 * i : 3 * i + 3] = block
    e = np.linalg.eigh(m)[1][:, :, 0].reshape(-1, 3, 3)
    u, d, vt = np.linalg.svd(e)
    # Two equal singular values and a zero one.
    mean = (d[:, 0] + d[:, 1]) / 2.0
    d = np.stack([mean, mean, np.zeros(len(d))], axis=1)
    return pd.Series(list(((u * d[:, None, :]) @ vt).reshape(-1, 9)))


def fit_homography(matches: DataFrame, key: str = "pair") -> DataFrame:
    """matches (pair, x, y, u, v) to (pair, n, h) for pairs with at least four matches."""
    rms = lambda a, b: F.sqrt(F.var_pop(a) + F.var_pop(b))
    stats = matches.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        rms("x", "y").alias("s1"), rms("u", "v").alias("s2"),
    ).filter((F.col("n") >= 4) & (F.col("s1") > 0) & (F.col("s2") > 0))
    k1, k2 = F.sqrt(F.lit(2.0)) / F.col("s1"), F.sqrt(F.lit(2.0)) / F.col("s2")
    norm = stats.select(key, "n", "mx", "my", k1.alias("k1"), "mu", "mv", k2.alias("k2"))
    j = matches.join(norm, key).select(
        key, ((F.col("x") - F.col("mx")) * F.col("k1")).alias("a"), ((F.col("y") - F.col("my")) * F.col("k1")).alias("b"),
        ((F.col("u") - F.col("mu")) * F.col("k2")).alias("c"), ((F.col("v") - F.col("mv")) * F.col("k2")).alias("d"),
    )
    pp = _outer((F.col("a"), F.col("b"), F.lit(1.0)))
    c, d = F.col("c"), F.col("d")
    sums = [F.sum(e) for e in pp] + [F.sum(c * e) for e in pp] + [F.sum(d * e) for e in pp] + [F.sum((c * c + d * d) * e) for e in pp]
    agg = j.groupBy(key).agg(F.array(*sums).alias("sums"))
    return agg.join(norm, key).select(key, "n", _homography("sums", F.array("mx", "my", "k1", "mu", "mv", "k2")).alias("h"))


def fit_essential(rays: DataFrame, key: str = "pair") -> DataFrame:
    """rays (pair, ax, ay, az, bx, by, bz) to (pair, n, e) with b^T E a = 0, for pairs with at least eight rays."""
    pa, pb = _outer(V.vec("ax", "ay", "az")), _outer(V.vec("bx", "by", "bz"))
    agg = rays.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(q * p) for q in pb for p in pa]).alias("sums"))
    return agg.filter("n >= 8").select(key, "n", _essential("sums").alias("e"))


def homography_residuals(matches: DataFrame, fits: DataFrame, key: str = "pair") -> DataFrame:
    """Adds the transfer error in the second image."""
    h = [F.element_at("h", k) for k in range(1, 10)]
    x, y = F.col("x"), F.col("y")
    w = h[6] * x + h[7] * y + h[8]
    du, dv = (h[0] * x + h[1] * y + h[2]) / w - F.col("u"), (h[3] * x + h[4] * y + h[5]) / w - F.col("v")
    return matches.join(fits.select(key, "h"), key).withColumn("transfer_error", F.sqrt(du * du + dv * dv)).drop("h")


def refine_homography(matches: DataFrame, threshold: float, rounds: int = 3, key: str = "pair") -> DataFrame:
    """Refit on the matches within ``threshold`` pixels, a few rounds."""
    fits = fit_homography(matches, key)
    for _ in range(rounds):
        fits = fit_homography(homography_residuals(matches, fits, key).filter(F.col("transfer_error") <= threshold), key)
    return fits
