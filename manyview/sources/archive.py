"""Column archives: a stored ZIP whose entries are zstd blobs named ``column.shape.dtype.zst``.

    spark.read.format("column_archive").option("table", "points").load("/data/*.zip")

Entry names carry shape and type, so a table is a list of entries and the Spark
columns they become. One input partition per (file, row range); each decodes only
the entries of its table.
"""

from __future__ import annotations

import glob
import io
import json
import re
import zipfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION = 4_000_000
BATCH_ROWS = 65536

# Entry prefix, then the Spark columns of its trailing dimension.
TABLES = {
    "images": [
        ("images/camera_indexes", ["camera_id bigint"]),
        ("images/quaternions_wxyz", ["qw double", "qx double", "qy double", "qz double"]),
        ("images/translations_xyz", ["tx double", "ty double", "tz double"]),
    ],
    "points": [
        ("points3d/positions_xyzw", ["x double", "y double", "z double", "w double"]),
        ("points3d/colors_rgb", ["r int", "g int", "b int"]),
        ("points3d/reprojection_errors", ["error float"]),
    ],
    "obs": [
        ("tracks/point_indexes", ["point_id bigint"]),
        ("tracks/image_indexes", ["image_id bigint"]),
        ("tracks/feature_indexes", ["feature_index bigint"]),
        ("tracks/keypoints_xy", ["x float", "y float"]),
    ],
    "features": [
        ("features/positions_xy", ["x float", "y float"]),
        ("features/affine_shapes", ["a11 float", "a12 float", "a21 float", "a22 float"]),
    ],
    "pairs": [
        ("image_pairs/image_index_pairs", ["image_i bigint", "image_j bigint"]),
        ("image_pairs/match_counts", ["matches bigint"]),
    ],
    "cluster_members": [
        ("clusters/member_images", ["image_id bigint"]),
        ("clusters/member_features", ["feature_index bigint"]),
    ],
}
# The row number becomes this column.
ROW_ID = {"images": "image_id", "points": "point_id", "features": "feature_index", "pairs": "pair_no", "cluster_members": "member_no", "obs": "obs_no"}
ENTRY = re.compile(r"^(?P<stem>.+?)\.(?P<shape>\d+(?:\.\d+)*)\.(?P<dtype>[a-z]+\d+)\.zst$")


class RowRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "column_archive"

    def schema(self) -> str:
        table = self.options["table"]
        if table == "metadata":
            return "file string, entry string, json string"
        fields = [c for _, cols in TABLES[table] for c in cols]
        return ", ".join(["file string", f"{ROW_ID[table]} bigint", *fields])

    def reader(self, schema) -> "ArchiveReader":
        return ArchiveReader(self.options["path"], self.options["table"])


def entries(z: zipfile.ZipFile) -> dict[str, tuple[str, list[int], str]]:
    """stem -> (entry name, shape, dtype)."""
    out = {}
    for n in z.namelist():
        m = ENTRY.match(n)
        if m:
            out[m["stem"]] = (n, [int(d) for d in m["shape"].split(".")], m["dtype"])
    return out


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob)).read()


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self):
        parts = []
        for p in sorted(glob.glob(self.path)):
            if self.table == "metadata":
                parts.append(RowRange(p, 0, 0))
                continue
            with zipfile.ZipFile(p) as z:
                have = entries(z)
            rows = max((have[s][1][0] for s, _ in TABLES[self.table] if s in have), default=0)
            parts += [RowRange(p, a, min(a + ROWS_PER_PARTITION, rows)) for a in range(0, rows, ROWS_PER_PARTITION)]
        return parts

    def read(self, part):
        with zipfile.ZipFile(part.path) as z:
            if self.table == "metadata":
                for n in z.namelist():
                    if n.endswith(".json.zst"):
                        yield (part.path, n[: -len(".zst")], _unpack(z.read(n)).decode("utf-8"))
                return
            have = entries(z)
            data = {s: self._range(z, have[s], part) for s, _ in TABLES[self.table] if s in have}
        for a in range(0, part.stop - part.start, BATCH_ROWS):
            b = min(a + BATCH_ROWS, part.stop - part.start)
            yield self._batch(part, data, a, b)

    def _range(self, z, entry, part) -> np.ndarray:
        """Decode an entry as a stream, keeping only this partition's rows."""
        name, shape, dtype = entry
        width = int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
        size = width * np.dtype(dtype).itemsize
        with z.open(name) as raw, zstandard.ZstdDecompressor().stream_reader(raw) as s:
            left = part.start * size
            while left:
                got = len(s.read(min(left, 1 << 22)))
                if not got:
                    raise ValueError(f"{name} ends early")
                left -= got
            want = (part.stop - part.start) * size
            buf = bytearray()
            while len(buf) < want:
                chunk = s.read(want - len(buf))
                if not chunk:
                    raise ValueError(f"{name} ends early")
                buf += chunk
        return np.frombuffer(bytes(buf), dtype=dtype).reshape(-1, width)

    def _batch(self, part, data, a, b) -> pa.RecordBatch:
        types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}
        cols = [pa.array([part.path] * (b - a)), pa.array(np.arange(part.start + a, part.start + b))]
        names = ["file", ROW_ID[self.table]]
        for stem, fields in TABLES[self.table]:
            for k, field in enumerate(fields):
                name, kind = field.split()
                names.append(name)
                if stem in data:
                    cols.append(pa.array(data[stem][a:b, k].astype(types[kind].to_pandas_dtype())))
                else:
                    cols.append(pa.nulls(b - a, types[kind]))
        return pa.RecordBatch.from_arrays(cols, names=names)


def write_archive(path: str, arrays: dict[str, np.ndarray], documents: dict[str, object], level: int = 3) -> None:
    """Write entries and JSON documents of one archive (export of a bounded scene)."""
    z = zstandard.ZstdCompressor(level=level)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        for name, doc in documents.items():
            out.writestr(f"{name}.json.zst", z.compress(json.dumps(doc).encode("utf-8")))
        for stem, a in arrays.items():
            shape = ".".join(str(d) for d in a.shape)
            out.writestr(f"{stem}.{shape}.{a.dtype.name}.zst", z.compress(np.ascontiguousarray(a).tobytes()))
