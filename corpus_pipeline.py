"""A corpus pipeline over ``documents``: five stages, each one operator of manyview.llm.

1. quality rules: rejected documents go;
2. line dedup: cross-site boilerplate lines go from the texts, and documents that have no
   other lines (their lines stand in the first document that has them);
3. MinHash near-dedup: the document with the smallest id of each class stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. mixing: documents are emitted as often as their source's weight says.

Every stage is written to the shared folder and read again before the next. Other columns
pass through all stages; null texts end with the first stage, as they have no words; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm import decontam, lines, mixing, near, quality
from manyview.llm.text import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs).filter("NOT _lines.emptied").drop("_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.dedup_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]

#: Estimated reliabilities (stage 1) have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that come out of all stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
