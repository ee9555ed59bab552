"""Incremental ingest skips what is done and survives being run again."""

from pyspark.sql import functions as F

from manyview.streaming.ingest import image_stream, ingest_features


def _extract(df):
    return df.select("content_hash", "tool_hash", F.length("content").alias("size"))


def test_ingest_is_incremental(spark, tmp_path):
    src = tmp_path / "images"
    src.mkdir()
    for i in range(3):
        (src / f"a{i}.jpg").write_bytes(bytes([i]) * 10)
    table, ckpt = str(tmp_path / "features"), str(tmp_path / "ckpt")

    def run():
        q = ingest_features(image_stream(spark, str(src)), "tool-1", table, _extract, ckpt)
        q.awaitTermination()

    run()
    assert spark.read.parquet(table).count() == 3
    (src / "copy.jpg").write_bytes(bytes([1]) * 10)
    (src / "new.jpg").write_bytes(b"xyz")
    run()
    got = spark.read.parquet(table)
    assert got.count() == 4 and got.select("content_hash").distinct().count() == 4
