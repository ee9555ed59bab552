"""Text exports: frame transforms as JSON lines and points as PLY vertex lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera
from ..functions import quat as Q
from ..functions import vec as V


def frame_transforms(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """One JSON text per image: file path, camera-to-world matrix and intrinsics."""
    q, t = Q.quat("qw", "qx", "qy", "qz"), V.vec("tx", "ty", "tz")
    r, c = Q.matrix(q), Q.camera_center(q, t)
    rows = [F.array(r[0][k], r[1][k], r[2][k], c[k]) for k in range(3)]
    last = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    k = camera.intrinsics()
    body = F.struct(
        F.col("name").alias("file_path"), F.array(*rows, last).alias("transform_matrix"), F.col("width").alias("w"), F.col("height").alias("h"),
        k["fx"].alias("fl_x"), k["fy"].alias("fl_y"), k["cx"].alias("cx"), k["cy"].alias("cy"),
    )
    return images.join(cameras, "camera_id").select("image_id", F.to_json(body).alias("json"))


def ply_vertices(points: DataFrame) -> DataFrame:
    """Vertex lines of the finite points; the header needs only their count."""
    xyz = [F.col(c) / F.col("w") for c in "xyz"]
    line = F.format_string("%.6f %.6f %.6f %d %d %d", *xyz, *[F.col(c).cast("int") for c in "rgb"])
    return points.filter("w <> 0").select("point_id", line.alias("line"))


def ply_header(vertices: int) -> str:
    fields = [f"property float {c}" for c in "xyz"] + [f"property uint8 {c}" for c in ("red", "green", "blue")]
    return "\n".join(["ply", "format ascii 1.0", f"element vertex {vertices}", *fields, "end_header"])
