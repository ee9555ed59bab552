"""Matches and two-view geometries in an SQLite feature database.

    spark.read.format("match_database").option("table", "matches").load("/work/database.db")

Pair ids hold both image ids; readers split the id range into partitions and each
task opens the file read-only in its own process.
"""

from __future__ import annotations

import os
import sqlite3
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: largest image id, the base of the pair id.
PAIR_BASE = 2147483647

# Geometry labels by number.
CONFIGS = (
    "undefined", "degenerate", "calibrated", "uncalibrated", "planar", "planar_or_panoramic", "panoramic", "multiple",
    "watermark_clean", "watermark_bad",
)

SCHEMAS = {
    "matches": "image_i bigint, image_j bigint, feature_i bigint, feature_j bigint",
    "two_view": (
        "image_i bigint, image_j bigint, config string, inliers bigint, f array<double>, e array<double>, h array<double>, "
        "q array<double>, t array<double>"
    ),
    "images": "image_id bigint, name string, camera_id bigint",
}
SQL_TABLE = {"matches": "matches", "two_view": "two_view_geometries", "images": "images"}
KEY = {"matches": "pair_id", "two_view": "pair_id", "images": "image_id"}


def pair_images(pair_id: Column) -> tuple[Column, Column]:
    """(i, j) of a pair id."""
    base = F.lit(PAIR_BASE).cast("long")
    j = F.pmod(pair_id, base)
    return ((pair_id - j) / base).cast("long"), j


def pair_id(i: Column, j: Column) -> Column:
    return F.least(i, j) * F.lit(PAIR_BASE).cast("long") + F.greatest(i, j)


def config_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIGS]), (code + 1).cast("int"))


class KeyRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class MatchDatabaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match_database"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> "MatchDatabaseReader":
        return MatchDatabaseReader(self.options["path"], self.options["table"], int(self.options.get("partitions", "8")))


class MatchDatabaseReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int):
        self.path, self.table, self.parts = path, table, parts

    def _open(self):
        return sqlite3.connect(f"file:{os.path.abspath(self.path)}?mode=ro", uri=True)

    def partitions(self):
        """Key ranges holding about equally many rows each, from the table's own key index."""
        key, table = KEY[self.table], SQL_TABLE[self.table]
        con = self._open()
        try:
            (n,) = con.execute(f"SELECT count(*) FROM {table}").fetchone()
            if not n:
                return []
            step = max(1, -(-n // self.parts))
            starts = [r[0] for r in con.execute(
                f"SELECT k FROM (SELECT {key} AS k, row_number() OVER (ORDER BY {key}) - 1 AS r FROM {table}) WHERE r % {step} = 0 ORDER BY k"
            )]
        finally:
            con.close()
        return [KeyRange(a, b) for a, b in zip(starts, [*starts[1:], 2**63 - 1])]

    def read(self, partition):
        key, table = KEY[self.table], SQL_TABLE[self.table]
        con = self._open()
        try:
            where = f"FROM {table} WHERE {key} >= ? AND {key} < ? ORDER BY {key}"
            args = (partition.low, partition.high)
            if self.table == "images":
                yield from con.execute(f"SELECT image_id, name, camera_id {where}", args)
            elif self.table == "matches":
                for pid, rows, data in con.execute(f"SELECT pair_id, rows, data {where}", args):
                    i, j = divmod(pid, PAIR_BASE)
                    for fi, fj in struct.iter_unpack("<II", data or b""):
                        yield i, j, fi, fj
            else:
                for pid, rows, config, *blobs in con.execute(f"SELECT pair_id, rows, config, F, E, H, qvec, tvec {where}", args):
                    i, j = divmod(pid, PAIR_BASE)
                    yield (i, j, CONFIGS[config], rows, *[_doubles(b) for b in blobs])
        finally:
            con.close()


def _doubles(blob: bytes | None):
    return None if blob is None else list(struct.unpack(f"<{len(blob) // 8}d", blob))


def write_matches(path: str, images: DataFrame, matches: DataFrame) -> None:
    """Write images and matches tables; rows stream in pair order through one SQLite writer."""
    con = sqlite3.connect(path)
    try:
        con.execute("CREATE TABLE IF NOT EXISTS images (image_id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, camera_id INTEGER NOT NULL)")
        con.execute("CREATE TABLE IF NOT EXISTS matches (pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB)")
        con.executemany("INSERT INTO images VALUES (?, ?, ?)", ((r["image_id"], r["name"], r["camera_id"]) for r in images.select("image_id", "name", "camera_id").toLocalIterator()))
        grouped = matches.groupBy(pair_id(F.col("image_i"), F.col("image_j")).alias("pair_id")).agg(
            F.sort_array(F.collect_list(F.struct("feature_i", "feature_j"))).alias("m")
        )
        con.executemany(
            "INSERT INTO matches VALUES (?, ?, 2, ?)",
            ((r["pair_id"], len(r["m"]), b"".join(struct.pack("<II", a, b) for a, b in r["m"])) for r in grouped.orderBy("pair_id").toLocalIterator()),
        )
        con.commit()
    finally:
        con.close()
