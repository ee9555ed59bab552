"""The radial spline term of camera models: a cubic on uniform pieces over [0, limit], and its inverse.

The curve starts at the axis with value and slope zero (its first two control values are zero,
the coefficients are the others) and is constant beyond the limit. A distorted distance is the
distance plus the curve; coefficients of a camera keep that sum increasing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("slope", T.DoubleType())])
#: Halvings that bracket an inverse to the last bit.
HALVINGS = 60


def evaluate(coefficients: np.ndarray, limit: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope of the curves (n, k) at the distances (n,); de Boor's triangle on four control values."""
    control = np.concatenate((np.zeros((len(d), 2)), coefficients), axis=1)
    pieces = control.shape[1] - 3
    at = np.clip(d / limit, 0.0, 1.0) * pieces
    piece = np.minimum(np.floor(at), pieces - 1).astype(np.int64)
    # In units of a piece the knots are 0, 1, ..., the end ones four times.
    knot = lambda i: np.clip(i, 0, pieces).astype(np.float64)
    rows = np.arange(len(d))
    points = [control[rows, piece + j] for j in range(4)]
    slope = None
    for level in range(1, 4):
        if level == 3:
            span = knot(piece + 1) - knot(piece)
            slope = 3.0 * (points[3] - points[2]) / span
        for j in range(3, level - 1, -1):
            low, high = knot(piece + j - 3), knot(piece + j + 1 - level)
            t = (at - low) / (high - low)
            points[j] = (1.0 - t) * points[j - 1] + t * points[j]
    slope = slope * pieces / limit
    return points[3], np.where(d > limit, 0.0, slope)


def invert(coefficients: np.ndarray, limit: np.ndarray, distorted: np.ndarray) -> np.ndarray:
    """The distances whose distorted distances are given."""
    reach = np.abs(coefficients).max(axis=1)
    low, high = np.maximum(distorted - reach, 0.0), np.maximum(distorted + reach, 0.0)
    for _ in range(HALVINGS):
        mid = 0.5 * (low + high)
        above = mid + evaluate(coefficients, limit, mid)[0] > distorted
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return 0.5 * (low + high)


def _by_length(coefficients: pd.Series, limit: pd.Series, d: pd.Series, width: int, solve) -> np.ndarray:
    """Runs ``solve`` for rows of equally many coefficients; fewer than two, or no positive limit: zero."""
    out = np.zeros((len(d), width))
    sizes = coefficients.map(lambda c: 0 if c is None else len(c)).to_numpy()
    lim, x = limit.to_numpy(dtype=np.float64), d.to_numpy(dtype=np.float64)
    sound = (sizes >= 2) & (lim > 0) & np.isfinite(lim)
    for n in np.unique(sizes[sound]):
        rows = np.flatnonzero(sound & (sizes == n))
        c = np.stack(coefficients.iloc[rows].to_numpy()).astype(np.float64)
        out[rows] = solve(c, lim[rows], x[rows])
    return out


@F.pandas_udf(TERM)
def spline_term(coefficients: pd.Series, limit: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Value and slope of the term at a distance from the axis."""
    out = _by_length(coefficients, limit, d, 2, lambda c, lim, x: np.column_stack(evaluate(c, lim, x)))
    return pd.DataFrame(out, columns=["value", "slope"])


@F.pandas_udf(T.DoubleType())
def spline_inverse(coefficients: pd.Series, limit: pd.Series, distorted: pd.Series) -> pd.Series:
    """The distance whose distance plus term is given; without a term, the given one."""
    x = distorted.to_numpy(dtype=np.float64)
    moved = _by_length(coefficients, limit, distorted, 1, lambda c, lim, y: (invert(c, lim, y) - y)[:, None])
    return pd.Series(x + moved[:, 0])
