"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from manyview.llm import merkle

from . import messy


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[c] for c in merkle.FIELDS[:-1]] + [text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes):
    """Root and, per node, the list of (members, own slot) from the bottom."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, at in enumerate(place):
            paths[k].append((runs[at // 8], at % 8))
        place, level = [at // 8 for at in place], [h(*run) for run in runs]
    return level[0] if level else None, paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((leaf(r, r["text"]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for x in langs:
        by[x].sort(key=lambda e: (e[1]["doc_id"] is not None, e[1]["doc_id"] or 0, e[0]))
        subs[x] = tree([e[0] for e in by[x]])
    root, tops = tree([subs[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        for (own, r), path in zip(by[x], subs[x][1]):
            text, ident = r["text"], r["doc_id"]
            if ident is not None and zlib.crc32(str(ident).encode()) % 3 == 0 and text is not None:
                text = text.translate(messy.LOWER)
            acc, proof = leaf(r, text), []
            for run, slot in path + top:
                proof += run[:slot] + run[slot + 1 :]
                acc = h(*run[:slot], acc, *run[slot + 1 :])
            out.append((ident, own, subs[x][0], root, h(*proof), acc, acc == root))
    return out


def query(spark, df, tmp):
    df.write.parquet(f"{tmp}/documents.parquet")
    return [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp)).collect()]


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_messy_rows(spark, tmp_path):
    df = messy.docs(spark)
    same(query(spark, df, tmp_path), plain([r.asDict() for r in df.collect()]))


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {None: 1, "a": 9, "b": 65}, {f"l{i}": 1 + i % 3 for i in range(20)}])
def test_shapes(spark, tmp_path, sizes):
    rows = [(n * 100 + i, f"Text {i} É", lang, None, i) for n, (lang, size) in enumerate(sizes.items()) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    same(query(spark, df, tmp_path), plain([r.asDict() for r in df.collect()]))


def test_hot_language_and_repeated_rows(spark):
    """Half of all rows in one language, a row 30 times: every copy has its own place and a proof that folds to the root."""
    rows = [(i, "x" if i % 2 else f"l{i % 7}") for i in range(300)] + [(5, "x")] * 30
    df = spark.createDataFrame(rows, "id long, lang string").repartition(4)
    made = merkle.leaf_digest([F.col("id"), F.col("lang")])
    got = merkle.manifest(df, "id", "lang", made, made).collect()
    assert len(got) == 330 and all(r["folded_root"] == r["root"] for r in got)
    assert len({r["root"] for r in got}) == 1 and sum(r["id"] == 5 for r in got) == 31


def test_empty_table(spark, tmp_path):
    assert query(spark, messy.empty(spark), tmp_path) == []
