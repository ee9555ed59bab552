"""Incremental ingest: only images without current features are handed on.

The stream source remembers which files it has listed; the content check against
the feature table makes a replayed batch harmless after a lost driver or executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

IMAGE_FILES = "path string, modificationTime timestamp, length long, content binary"


def pending(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images whose (content, tool) hash is not among the finished ones."""
    key = ["content_hash", "tool_hash"]
    return images.join(done.select(*key).distinct(), key, "left_anti")


def image_stream(spark: SparkSession, directory: str, pattern: str = "*.jpg", files_per_batch: int = 1000) -> DataFrame:
    """New image files under a directory as (path, content, content_hash)."""
    raw = (
        spark.readStream.format("binaryFile").schema(IMAGE_FILES)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).load(directory)
    )
    return raw.select("path", "content", F.md5("content").alias("content_hash"))


def ingest_features(
    images: DataFrame, tool_hash: str, feature_table: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str
) -> StreamingQuery:
    """Run ``extract`` on the pending images of each batch and append to a Parquet feature table.

    Output is partitioned by batch, and a batch overwrites only its own partition,
    so a batch that is run twice leaves one copy.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["content_hash"]).withColumn("tool_hash", F.lit(tool_hash))
        try:
            done = spark.read.parquet(feature_table).filter(F.col("batch_id") != batch_id)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        if done is not None:
            fresh = pending(fresh, done)
        (
            extract(fresh).withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(feature_table)
        )

    return (
        images.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
