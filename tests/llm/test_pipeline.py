"""Every stage of the corpus pipeline against brute force on its own input."""

import random

import pytest

import corpus_pipeline
from manyview.llm import mixing

from . import messy


def corpus():
    rng = random.Random(21)
    items = [messy.sentence(rng, 30) for _ in range(4)]

    def text(n=60):
        return "\n".join(f"The {messy.sentence(rng, 12)} of the {messy.sentence(rng, 6)} and the rest." for _ in range(n // 20))

    rows = [(i, text(), "en", f"s{i % 12}", 0) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", f"s{i % 5}", 0) for i in range(12)]  # copies
    rows += [(200 + i, "the shared notice of all sites\n" + text(), "en", f"s{i}", 0) for i in range(12)]
    rows += [(300 + i, text() + "\n" + items[i % 4] + "\n" + text(), "de", None, 0) for i in range(8)]
    rows += [(400 + i, text().upper() + " AND!! SO!! ON!!" * 40, None, "s1", 0) for i in range(6)]
    rows += [(500, None, "en", "s1", 0), (501, "", "en", "s1", 0), (502, "too short", "en", "s2", 0), (None, text(), "en", "s3", 0)]
    rows.append(rows[0])
    return rows, items


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rows, items = corpus()
    d = str(tmp_path_factory.mktemp("corpus"))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{place}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, place))
        after = docs.collect()
        ids = sorted(r["doc_id"] for r in after if r["doc_id"] is not None)
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert ids == sorted(r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] < 400)
        if name == "line_dedup":
            text = {r["doc_id"]: r["text"] for r in after}
            assert sum("the shared notice" in t for t in text.values()) == 1 and "the shared notice" in text[200]
            assert ids == sorted(r["doc_id"] for r in before if r["doc_id"] is not None)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "near_dedup":
            want = messy.classes([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
            assert ids == sorted(i for i, c in want.items() if i == c) and len(after) == len(ids) + 1
        if name == "decontamination":
            leaked = {r["doc_id"] for r in before if any(x in r["text"] for x in items)}
            assert leaked == set(range(300, 308)) and ids == sorted(r["doc_id"] for r in before if r["doc_id"] not in leaked | {None})
        if name == "mixing":
            per = mixing.copies(mixing.sized(spark.createDataFrame(before, docs.drop("mix_copy").schema))).collect()
            assert len(after) == sum(r["copies"] for r in per) and docs.columns == [*columns, "mix_copy"]
            assert {(r["doc_id"], r["mix_copy"]) for r in after} == {(r["doc_id"], k) for r in per for k in range(1, r["copies"] + 1)}
    run = sorted(((r["doc_id"] or -1, r["text"], r["mix_copy"]) for r in corpus_pipeline.run(spark, place).collect()))
    assert run == sorted((r["doc_id"] or -1, r["text"], r["mix_copy"]) for r in after)


def test_stages_on_an_empty_table(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, place)
    assert docs.count() == 0


def test_stages_keep_other_columns(spark, place):
    docs = messy.docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, place))
        assert docs.columns[: len(messy.SCHEMA.split(","))] == messy.docs(spark).columns, name
