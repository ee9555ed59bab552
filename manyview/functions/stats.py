"""Closed-form statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_lower_bound(k: Column, n: Column, z: float) -> Column:
    """Wilson score lower bound of k / n; zero for an empty denominator."""
    n = n.cast("double")
    p = k.cast("double") / n
    zz = z * z
    mid = p + zz / (2.0 * n)
    half = z * F.sqrt(p * (1.0 - p) / n + zz / (4.0 * n * n))
    return F.when(n > 0, F.greatest((mid - half) / (1.0 + zz / n), F.lit(0.0))).otherwise(F.lit(0.0))
