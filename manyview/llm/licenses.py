"""License scans (operator 1): TF-IDF cosine to templates, then inheritance down the tree.

Whole texts are cut into statements (lines, and sentences of lines); those with a cue word
are compared with statement templates by sparse TF-IDF cosine. Equal statements are one row,
so a header that a third of all files carry is weighed and compared once. Term weights come
from the corpus: document frequencies over all statements with a cue, counted per file.
A file's own license is its best statement's. A directory has the license of its licence
files (by name, or files that say little else); a file without one takes that of its nearest
ancestor directory, found by joining the distinct directories' ancestors with the licensed ones.

DataFrame functions only. Defined results: null and empty texts have no statements; a null
path has no directory and inherits nothing; repeated rows are files of their own with equal
results; ties go to the smaller license id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import WORD, n_words, staged, table

#: Statements by license. The licenses' own public names and opening sentences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Do not copy or redistribute."),
}
CUE = r"(?i)licen[sc]|copyright|all rights reserved|permission is hereby granted|redistribution and use|apache-|general public|source code form"
SIMILAR = 0.6
#: A file is a licence file by name, or if statements of its license are so large a share of its words.
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
FILE_SHARE = 0.1


def _terms(statement: Column) -> Column:
    """Lower-case terms; versions and identifiers such as 2.0 and by-nc stay whole."""
    return F.regexp_extract_all(F.lower(statement), F.lit(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"), F.lit(0))


def _statements(text: Column) -> Column:
    parts = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(CUE), F.split(x, r"(?<=[.;!?])\s+")).otherwise(F.array())))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.rlike(CUE)))


def template_scores(statements: DataFrame, n_files: int, templates=TEMPLATES) -> DataFrame:
    """(statement, files) of distinct statements to their best license and cosine."""
    spark = statements.sparkSession
    rows = [(name, i, t) for name, ts in sorted(templates.items()) for i, t in enumerate(ts)]
    known = spark.createDataFrame(rows, "license string, number int, statement string")
    df = statements.select(F.explode(F.array_distinct(_terms(F.col("statement")))).alias("term"), "files").groupBy("term").agg(F.sum("files").alias("df"))

    def vectors(frame: DataFrame, keys: list[str]) -> DataFrame:
        tf = frame.select(*keys, F.explode(_terms(F.col("statement"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
        idf = F.log((F.lit(n_files) + 1) / (F.least(F.coalesce("df", F.lit(0)), F.lit(n_files)) + 1)) + 1
        return tf.join(df, "term", "left").select(*keys, "term", (F.col("tf") * idf).alias("w"))

    ours = vectors(statements, ["statement"])
    theirs = vectors(known, ["license", "number"])
    norm = theirs.groupBy("license", "number").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn"))
    theirs = theirs.join(norm, ["license", "number"]).withColumnRenamed("w", "tw")
    own_norm = ours.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("sn"))
    dots = ours.join(theirs, "term").groupBy("statement", "license", "number", "tn").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(own_norm, "statement").select("statement", "license", F.round(F.col("dot") / (F.col("sn") * F.col("tn")), 9).alias("score"))
    best = scored.groupBy("statement").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("statement", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def own_licenses(files: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(file, path, license, score, share) of every row of files (file, path, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    said = files.select("file", "path", n_words(text).alias("words"), F.when(text.rlike(CUE), _statements(text)).otherwise(F.array().cast("array<string>")).alias("said"))
    said = staged(said)
    each = said.select(F.explode("said").alias("statement"))
    distinct = staged(each.groupBy("statement").agg(F.count(F.lit(1)).alias("files")))
    scores = template_scores(distinct, said.count()).filter(F.col("score") >= similar)
    hit = said.select("file", F.explode("said").alias("statement")).join(scores, "statement")
    hit = hit.select("file", "license", "score", n_words(F.col("statement")).alias("n"))
    best = hit.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.sum("n").alias("n"))
    out = said.select("file", "path", "words").join(best, "file", "left")
    return out.select("file", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (F.coalesce("n", F.lit(0)) / F.greatest("words", F.lit(1))).alias("share"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def _ancestors(d: Column) -> Column:
    """The directory and all above it, with their depths; the root is the empty path."""
    parts = F.split(d, "/")
    n = F.when(d == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")).alias("dir"), k.alias("depth")))


def inherit(owned: DataFrame) -> DataFrame:
    """Adds ``effective`` (own or inherited license) and ``inherited_from`` (the directory)."""
    own = staged(owned.withColumn("dir", directory(F.col("path"))))
    is_file = F.col("path").rlike(FILE_NAME) | (F.col("share") >= FILE_SHARE)
    of_dir = own.filter(F.col("license").isNotNull() & F.col("dir").isNotNull() & is_file)
    of_dir = of_dir.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license"))
    dirs = own.select("dir").dropna().distinct().select(F.col("dir").alias("of"), F.explode(_ancestors(F.col("dir"))).alias("a")).select("of", "a.dir", "a.depth")
    nearest = dirs.join(of_dir, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n"))
    out = own.join(nearest.withColumnRenamed("of", "dir"), "dir", "left")
    none = F.col("license").isNull()
    return out.select(
        "file", "path", "license", "score", F.coalesce("license", "n.dir_license").alias("effective"), F.when(none, F.col("n.dir")).alias("inherited_from")
    )


def scan_licenses(files: DataFrame) -> DataFrame:
    """files (path, text) to file (a row number), path, license, score, effective, inherited_from."""
    return inherit(own_licenses(files.select(F.monotonically_increasing_id().alias("file"), "path", "text")))


def doc_path() -> Column:
    """Documents stand in directories by source and language."""
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TERM_SQL = r"regexp_extract_all(lower({c}), '[a-z0-9]+(?:[.\-][a-z0-9]+)*')"
SCAN_SQL = rf"""
WITH d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
p AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(line, '([.;!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM l WHERE regexp_matches(line, '{CUE}')),
said AS (SELECT DISTINCT doc_id, s FROM p WHERE regexp_matches(s, '{CUE}')),
st AS (SELECT s, count(*) AS files FROM said GROUP BY s),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, sum(files) AS df FROM (SELECT s, files, unnest(list_distinct({_TERM_SQL.format(c="s")})) AS term FROM st) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (least(df, n) + 1)) + 1 AS idf FROM df, n),
known(license, t) AS (VALUES {", ".join(f"({_quoted(name)}, {_quoted(t)})" for name, ts in TEMPLATES.items() for t in ts)}),
v AS (SELECT s, term, count(*) * any_value(idf) AS w FROM (SELECT s, unnest({_TERM_SQL.format(c="s")}) AS term FROM st) JOIN idf USING (term) GROUP BY s, term),
u AS (SELECT license, t, term, count(*) * any_value(coalesce(idf, ln(n + 1) + 1)) AS w FROM (SELECT license, t, unnest({_TERM_SQL.format(c="t")}) AS term FROM known) LEFT JOIN idf USING (term), n GROUP BY license, t, term),
vn AS (SELECT s, sqrt(sum(w * w)) AS sn FROM v GROUP BY s),
un AS (SELECT license, t, sqrt(sum(w * w)) AS tn FROM u GROUP BY license, t),
dot AS (SELECT s, license, t, sum(v.w * u.w) AS dot FROM v JOIN u USING (term) GROUP BY s, license, t),
sc AS (SELECT s, license, round(dot / (sn * tn), 9) AS score FROM dot JOIN vn USING (s) JOIN un USING (license, t)),
best AS (SELECT s, license, score FROM sc QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, license) = 1),
hit AS (SELECT doc_id, license, score, len(regexp_extract_all(s, '{WORD}')) AS k FROM said JOIN best USING (s) WHERE score >= {SIMILAR}),
own AS (SELECT d.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, h.license, h.score, coalesce(k, 0) / greatest(len(regexp_extract_all(text, '{WORD}')), 1) AS share
  FROM d LEFT JOIN (SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score, sum(k) AS k FROM hit GROUP BY doc_id) h ON h.doc_id = d.doc_id),
dirs AS (SELECT dir AS top, arg_min(license, (-score, license)) AS dir_license FROM own WHERE license IS NOT NULL AND (regexp_matches(path, '{FILE_NAME}') OR share >= {FILE_SHARE}) GROUP BY dir),
near AS (SELECT o.dir, top, dir_license FROM (SELECT DISTINCT dir FROM own) o JOIN dirs ON o.dir = top OR starts_with(o.dir, top || '/') QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY length(top) DESC) = 1)
SELECT doc_id, license, round(score, 6) AS score, coalesce(license, dir_license) AS effective, CASE WHEN license IS NULL THEN top END AS inherited_from
FROM own LEFT JOIN near ON near.dir = own.dir"""


@query("op1_license_scan", SCAN_SQL)
def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), doc_path().alias("path"), "text")
    out = inherit(own_licenses(docs))
    return out.select(F.col("file").alias("doc_id"), "license", F.round("score", 6).alias("score"), "effective", "inherited_from")
