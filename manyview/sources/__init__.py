"""Readers and writers of the external file formats.

Each reader is a Python data source: one input partition per file or key range,
rows streamed out of the task that opened the file. After the first read, keep
the tables as Parquet and let Spark prune columns and rows.
"""

from pyspark.sql import SparkSession

from .archive import ArchiveSource
from .colmap import ColmapModelSource
from .matchdb import MatchDatabaseSource


def register(spark: SparkSession) -> None:
    for source in (ArchiveSource, ColmapModelSource, MatchDatabaseSource):
        spark.dataSource.register(source)
