"""The reconstruction as a bundle of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Recon:
    """images, points and the observation fact table, plus optional tables.

    images(image_id, name, camera_id, qw, qx, qy, qz, tx, ty, tz)
    points(point_id, x, y, z, w, error, ...)
    obs(point_id, image_id, feature_index?, x?, y?, ...)
    """

    images: DataFrame
    points: DataFrame
    obs: DataFrame
    cameras: DataFrame | None = None
    sensors: DataFrame | None = None
    image_frames: DataFrame | None = None
    features: DataFrame | None = None

    def with_(self, **tables) -> "Recon":
        return replace(self, **tables)

    def transform(self, *steps: Callable[["Recon"], "Recon"]) -> "Recon":
        """Apply steps in order; nothing runs until a table is consumed."""
        return reduce(lambda recon, step: step(recon), steps, self)
