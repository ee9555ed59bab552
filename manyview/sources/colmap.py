"""Binary sparse models: cameras.bin, images.bin and points3D.bin.

    spark.read.format("colmap_model").option("table", "obs").load("/models/*")
"""

from __future__ import annotations

import glob
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.camera import PARAM_NAMES

# Numeric ids of the camera models in binary files.
MODEL_IDS = {
    0: "SIMPLE_PINHOLE", 1: "PINHOLE", 2: "SIMPLE_RADIAL", 3: "RADIAL", 4: "OPENCV", 5: "OPENCV_FISHEYE",
    6: "FULL_OPENCV", 8: "SIMPLE_RADIAL_FISHEYE", 9: "RADIAL_FISHEYE", 10: "THIN_PRISM_FISHEYE",
    11: "RAD_TAN_THIN_PRISM_FISHEYE",
}

SCHEMAS = {
    "cameras": "model_dir string, camera_id bigint, model string, width bigint, height bigint, params map<string,double>",
    "images": (
        "model_dir string, image_id bigint, name string, camera_id bigint, qw double, qx double, qy double, qz double, "
        "tx double, ty double, tz double"
    ),
    "keypoints": "model_dir string, image_id bigint, feature_index bigint, x double, y double, point_id bigint",
    "points": "model_dir string, point_id bigint, x double, y double, z double, w double, r int, g int, b int, error double",
    "obs": "model_dir string, point_id bigint, image_id bigint, feature_index bigint",
}
FILES = {"cameras": "cameras.bin", "images": "images.bin", "keypoints": "images.bin", "points": "points3D.bin", "obs": "points3D.bin"}


class ModelPartition(InputPartition):
    def __init__(self, directory: str):
        self.directory = directory


class ColmapModelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colmap_model"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> "ColmapModelReader":
        return ColmapModelReader(self.options["path"], self.options["table"])


class ColmapModelReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self):
        """One partition per model directory; the files hold no offsets to split on."""
        dirs = sorted(d for d in glob.glob(self.path) if os.path.exists(os.path.join(d, FILES[self.table])))
        return [ModelPartition(d) for d in dirs]

    def read(self, partition):
        if partition is None:
            return
        with open(os.path.join(partition.directory, FILES[self.table]), "rb", buffering=1 << 20) as f:
            for row in READERS[self.table](f):
                yield (partition.directory, *row)


def _take(f, fmt: str):
    fmt = "<" + fmt
    return struct.unpack(fmt, f.read(struct.calcsize(fmt)))


def _cameras(f):
    (n,) = _take(f, "Q")
    for _ in range(n):
        camera_id, model_id, width, height = _take(f, "IiQQ")
        names = PARAM_NAMES[MODEL_IDS[model_id]]
        yield camera_id, MODEL_IDS[model_id], width, height, dict(zip(names, _take(f, f"{len(names)}d")))


def _image_heads(f):
    (n,) = _take(f, "Q")
    for _ in range(n):
        (image_id,) = _take(f, "I")
        pose = _take(f, "7d")
        (camera_id,) = _take(f, "I")
        name = bytearray()
        while (c := f.read(1)) not in (b"\0", b""):
            name += c
        (count,) = _take(f, "Q")
        yield image_id, pose, camera_id, name.decode("utf-8"), count


def _images(f):
    for image_id, pose, camera_id, name, count in _image_heads(f):
        f.seek(24 * count, os.SEEK_CUR)
        yield image_id, name, camera_id, *pose


def _keypoints(f):
    for image_id, _, _, _, count in _image_heads(f):
        for k in range(count):
            x, y, point = _take(f, "ddq")
            yield image_id, k, x, y, (point if point >= 0 else None)


def _point_heads(f):
    (n,) = _take(f, "Q")
    for _ in range(n):
        yield (*_take(f, "Q3d3BdQ"),)


def _points(f):
    for pid, x, y, z, r, g, b, error, length in _point_heads(f):
        f.seek(8 * length, os.SEEK_CUR)
        yield pid, x, y, z, 1.0, r, g, b, error


def _obs(f):
    for pid, *_, length in _point_heads(f):
        for _ in range(length):
            image_id, feature = _take(f, "II")
            yield pid, image_id, feature


READERS = {"cameras": _cameras, "images": _images, "keypoints": _keypoints, "points": _points, "obs": _obs}


def write_model(directory: str, cameras: DataFrame, images: DataFrame, keypoints: DataFrame, points: DataFrame, obs: DataFrame) -> None:
    """Write one model. Rows stream to the driver in id order, one partition at a time.

    A model file is one sequential stream, so this is for models a single tool will
    open; larger scenes stay in Parquet.
    """
    os.makedirs(directory, exist_ok=True)
    ids = {v: k for k, v in MODEL_IDS.items()}
    with open(os.path.join(directory, "cameras.bin"), "wb") as f:
        f.write(struct.pack("<Q", cameras.count()))
        for r in cameras.orderBy("camera_id").toLocalIterator():
            names = PARAM_NAMES[r["model"]]
            f.write(struct.pack("<IiQQ", r["camera_id"], ids[r["model"]], r["width"], r["height"]))
            f.write(struct.pack(f"<{len(names)}d", *[r["params"][n] for n in names]))
    kps = keypoints.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("feature_index", "x", "y", "point_id"))).alias("kp"))
    with open(os.path.join(directory, "images.bin"), "wb") as f:
        f.write(struct.pack("<Q", images.count()))
        for r in images.join(kps, "image_id", "left").orderBy("image_id").toLocalIterator():
            f.write(struct.pack("<I7dI", r["image_id"], *[r[c] for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], r["camera_id"]))
            f.write(r["name"].encode("utf-8") + b"\0")
            kp = r["kp"] or []
            f.write(struct.pack("<Q", len(kp)))
            for k in kp:
                f.write(struct.pack("<ddq", k["x"], k["y"], -1 if k["point_id"] is None else k["point_id"]))
    tracks = obs.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("image_id", "feature_index"))).alias("tr"))
    with open(os.path.join(directory, "points3D.bin"), "wb") as f:
        f.write(struct.pack("<Q", points.count()))
        for r in points.join(tracks, "point_id", "left").orderBy("point_id").toLocalIterator():
            tr = r["tr"] or []
            f.write(struct.pack("<Q3d3BdQ", r["point_id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["error"], len(tr)))
            for t in tr:
                f.write(struct.pack("<II", t["image_id"], t["feature_index"]))
