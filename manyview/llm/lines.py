"""Line dedup by distinct-site spread (operator 9).

Lines are hashed once; per line hash a HyperLogLog sketch of the sites it stands on is
merged by partial aggregation. Lines far above the threshold are boilerplate by the
sketch, lines within the band around it get exact distinct counts, the rest stay. A
boilerplate line is removed everywhere but at its first place (smallest doc_id, then
position), so no content leaves the corpus as a whole.

What is shuffled is (hash, site, place) per line, never text, until the removals of a
document meet its text. A very frequent line is combined on the map side before the
shuffle; its occurrences join a side with one row per line, which adaptive execution splits.

Defined results: a line is what stands between line breaks, compared without blanks at its
ends; lines without a word are never removed; null text stays null; a null site counts as
a site of its own; repeated rows with one doc_id and position are one place; rows without
doc_id count but keep all their lines; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import packed, staged, table, unpacked

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers: a standard error of 6.5 %.
LG_K = 8
#: Estimates within these multiples of the threshold (over five standard errors) are counted exactly.
BAND = (0.65, 1.5)

BLANKS = " \t\n\x0b\x0c\r"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_places(docs: DataFrame, site: str) -> DataFrame:
    """(h, site, doc_id, pos) of every line with a word."""
    site_ = F.coalesce(F.col(site).cast("string"), F.lit("\0"))
    split = docs.select(site_.alias("site"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = split.withColumn("line", _trim(F.col("line"))).filter("line <> ''")
    return cut.select(F.xxhash64("line").alias("h"), "site", "doc_id", "pos")


def boilerplate(places: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, first) of the lines on at least ``min_sites`` sites."""
    spread = places.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"), F.min(F.struct("doc_id", "pos")).alias("first")
    )
    wide = staged(spread.filter(F.col("estimate") >= BAND[0] * min_sites))
    near = wide.filter(F.col("estimate") <= BAND[1] * min_sites)
    exact = places.join(near.select("h"), "h", "left_semi").select("h", "site").distinct().groupBy("h").count().filter(F.col("count") >= min_sites)
    sure = wide.filter(F.col("estimate") > BAND[1] * min_sites)
    return sure.select("h", "first").unionByName(near.join(exact, "h", "left_semi").select("h", "first"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with cleaned ``text`` and a struct ``_lines``: n_lines, n_removed, emptied (had
    lines with words and has none left)."""
    places = staged(line_places(docs, site))
    common = boilerplate(places, min_sites)
    hit = places.join(common, "h").filter(F.col("doc_id").isNotNull())
    away = hit.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
    removed = away.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("pos")).alias("_away"), F.collect_set("h").alias("_gone"))
    out = packed(docs, "doc_id", "text").join(removed, F.col("doc_id") == F.col("_id"), "left")
    lines = F.split("text", "\n")
    worded = F.size(F.filter(lines, lambda x: _trim(x) != ""))
    gone = lambda x, i: F.array_contains("_away", i) & F.array_contains("_gone", F.xxhash64(_trim(x)))
    kept = F.when(F.col("_away").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~gone(x, i)), "\n"))
    out = out.withColumn("_kept", kept).withColumn("_n", F.when(F.col("text").isNull(), 0).otherwise(worded))
    left = F.size(F.filter(F.split("_kept", "\n"), lambda x: _trim(x) != ""))
    left = F.when(F.col("_away").isNull(), F.col("_n")).otherwise(left)
    out = out.withColumn("_left", left)
    info = F.struct(
        F.col("_n").cast("long").alias("n_lines"),
        (F.col("_n") - F.col("_left")).cast("long").alias("n_removed"),
        ((F.col("_n") > 0) & (F.col("_left") == 0)).alias("emptied"),
    )
    return unpacked(out, [c for c in docs.columns if c != "_lines"], info.alias("_lines"), doc_id=F.col("doc_id"), text=F.col("_kept"))


LINES_SQL = r"""
WITH parts AS (SELECT doc_id, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS p FROM documents),
l AS (SELECT doc_id, site, unnest(range(len(p))) AS pos, unnest(p) AS line FROM parts),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l),
b AS (SELECT k, min({'d': doc_id, 'p': pos}) AS first FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10),
m AS (SELECT t.*, b.k IS NOT NULL AND (doc_id <> first.d OR pos <> first.p) AS away FROM t LEFT JOIN b ON t.k = b.k)
SELECT d.doc_id, coalesce(count(*) FILTER (m.k <> ''), 0)::BIGINT AS n_lines, coalesce(count(*) FILTER (away), 0)::BIGINT AS n_removed,
  coalesce(count(*) FILTER (m.k <> '') > 0 AND count(*) FILTER (m.k <> '' AND NOT away) = 0, false) AS emptied,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT away), '')) AS text_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""


@query("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines, as digests of their texts."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "_lines.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
