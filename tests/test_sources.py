"""File formats: what is written comes back."""

import sqlite3
import struct

import numpy as np

from manyview import sources
from manyview.sources import archive, colmap, matchdb


def test_model_round_trip(spark, tmp_path):
    sources.register(spark)
    cams = spark.createDataFrame(
        [(1, "SIMPLE_RADIAL", 600, 400, {"focal_length": 512.0, "principal_point_x": 301.0, "principal_point_y": 199.0, "radial_distortion_k1": 0.02})],
        colmap.SCHEMAS["cameras"].replace("model_dir string, ", ""),
    )
    imgs = spark.createDataFrame([(7, "a/b (3).jpg", 1, 1.0, 0.0, 0.0, 0.0, 0.5, 0.25, -1.0), (9, "c.jpg", 1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                                 colmap.SCHEMAS["images"].replace("model_dir string, ", ""))
    kps = spark.createDataFrame([(7, 0, 1.5, 2.5, 100), (7, 1, 3.0, 4.0, None)], colmap.SCHEMAS["keypoints"].replace("model_dir string, ", ""))
    pts = spark.createDataFrame([(100, 1.0, 2.0, 3.0, 1.0, 10, 20, 30, 0.5)], colmap.SCHEMAS["points"].replace("model_dir string, ", ""))
    obs = spark.createDataFrame([(100, 7, 0), (100, 9, 4)], colmap.SCHEMAS["obs"].replace("model_dir string, ", ""))
    d = str(tmp_path / "model")
    colmap.write_model(d, cams, imgs, kps, pts, obs)
    for table, df in (("cameras", cams), ("images", imgs), ("keypoints", kps), ("points", pts), ("obs", obs)):
        back = spark.read.format("colmap_model").option("table", table).load(d).drop("model_dir")
        key = lambda r: str(r)
        assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, df.collect()), key=key), table


def test_match_database(spark, tmp_path):
    sources.register(spark)
    path = str(tmp_path / "m.db")
    imgs = spark.createDataFrame([(i, f"i{i}.jpg", 1) for i in range(1, 6)], "image_id long, name string, camera_id long")
    rows = [(i, j, f, f + 1) for i in range(1, 5) for j in range(i + 1, 6) for f in range(3)]
    matchdb.write_matches(path, imgs, spark.createDataFrame(rows, "image_i long, image_j long, feature_i long, feature_j long"))
    got = spark.read.format("match_database").option("table", "matches").option("partitions", "3").load(path)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE two_view_geometries (pair_id INTEGER PRIMARY KEY, rows INTEGER, cols INTEGER, data BLOB, config INTEGER, F BLOB, E BLOB, H BLOB, qvec BLOB, tvec BLOB)")
    nine = struct.pack("<9d", *range(9))
    con.execute("INSERT INTO two_view_geometries VALUES (?, 5, 2, NULL, 2, ?, NULL, NULL, ?, ?)",
                (2 * matchdb.PAIR_BASE + 4, nine, struct.pack("<4d", 1, 0, 0, 0), struct.pack("<3d", 1, 2, 3)))
    con.commit()
    con.close()
    r = spark.read.format("match_database").option("table", "two_view").load(path).first()
    assert (r["image_i"], r["image_j"], r["config"], r["inliers"]) == (2, 4, "calibrated", 5)
    assert r["f"] == [float(k) for k in range(9)] and r["e"] is None and r["t"] == [1.0, 2.0, 3.0]


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    sources.register(spark)
    rng = np.random.default_rng(3)
    pos = rng.normal(size=(1000, 4))
    err = rng.random(1000).astype("float32")
    p = str(tmp_path / "scene.zip")
    archive.write_archive(p, {"points3d/positions_xyzw": pos, "points3d/reprojection_errors": err,
                              "points3d/colors_rgb": np.full((1000, 3), 200, "uint8")}, {"metadata": {"version": 6}})
    df = spark.read.format("column_archive").option("table", "points").load(p)
    got = df.orderBy("point_id").toPandas()
    assert np.array_equal(got[["x", "y", "z", "w"]].to_numpy(), pos)
    assert np.array_equal(got["error"].to_numpy(), err) and set(got["b"]) == {200}
    meta = spark.read.format("column_archive").option("table", "metadata").load(p).first()
    assert meta["entry"] == "metadata.json" and '"version": 6' in meta["json"]
    monkeypatch.setattr(archive, "ROWS_PER_PARTITION", 300)
    part = archive.ArchiveReader(p, "points").partitions()[2]
    with __import__("zipfile").ZipFile(p) as z:
        rows = archive.ArchiveReader(p, "points")._range(z, archive.entries(z)["points3d/positions_xyzw"], part)
    assert np.array_equal(rows, pos[600:900])
