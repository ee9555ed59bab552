"""Pairs of shared groups: the number of partitions follows the rows, a hot group's copies included."""

import itertools
from collections import Counter

from pyspark.sql import functions as F

from manyview.operators import pairs, skew


def test_partitions_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "PART_ROWS", 200)
    rows = [(g, i) for g in range(600) for i in range(g % 5)] + [(1000, i) for i in range(120)] * 2
    df = spark.createDataFrame(rows, "g long, image_id long").repartition(3)
    distinct = df.distinct()
    parts = skew.pair_parts(distinct, ["g"], block=30)
    assert parts == -(-(1200 + 120 * 4) // 200) == 9
    found = skew.self_pairs(distinct, ["g"], "image_id", block=30, parts=parts)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == parts
    got = {(r["i"], r["j"]): r["shared"] for r in pairs.shared_counts(df, "g").collect()}
    want = Counter(p for g in range(600) for p in itertools.combinations(range(g % 5), 2)) + Counter(itertools.combinations(range(120), 2))
    assert got == want
    assert pairs.shared_counts(df.filter("false"), "g").count() == 0
