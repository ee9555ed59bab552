"""Mixing sources to target weights (operator 8).

Tokens are aggregated per source; weights share a budget, each source's target stops
at ``most`` times its size and the excess is reshared. With rate = target / size of the
source, a document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction. The draws of one source are tied to the rank of its documents
by size: document number i takes its extra copy if an integer lies in
(i * p + u, (i + 1) * p + u], u being the hash of source and seed. Every document's
chance is p, and what a source takes differs from its target by one document at most,
where independent draws would leave large documents to luck.

DataFrame functions only. Defined results: null text counts 0 words; null source is a
source of its own, last in order; repeated rows are documents of their own; a source
without words has target 0 and its documents are not taken; an empty table gives an
empty result; other columns (also of the names used here) pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import global_rank
from .registry import query
from .text import n_words, staged, table

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix against words of the input, in percent.
SHARE = 150
#: A target stops at so many times its source's size.
MOST = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The level every open source is filled to per unit of weight rises until no target is
    above its cap; all sums are whole numbers, so the result doesn't depend on their order.
    """
    ranked = global_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], out="_rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    src = staged(ranked.select("source", "source_size", w.cast("long").alias("_w")))
    cap = F.col("source_size") * most
    total = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stuck = 0.0, None
    while True:
        above = cap < F.lit(level) * F.col("_w")
        row = src.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0)).alias("open"),
        ).first()
        if row["open"] == 0 or (row["capped"], row["open"]) == stuck:
            break
        stuck = (row["capped"], row["open"])
        level = (share * total / 100 - row["capped"]) / row["open"]
    return src.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def unit_hash(c: Column) -> Column:
    """A number in [0, 1) from the md5 of a string."""
    return F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(docs: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, size) with source_size, target and copies."""
    docs = staged(docs.select("doc_id", "source", "size"))
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per, weights, share, most)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    keyed = docs.withColumn("_key", key).withColumn("_none", F.col("source").isNull()).withColumn("_of", F.coalesce("source", F.lit("")))
    ranked = global_rank(keyed, ["size", "_key", "doc_id"], ["_none", "_of"], "_pos")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = ranked.join(targets.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    u = unit_hash(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("source"), F.lit("\0"))))
    p = F.col("_rate") - F.floor("_rate")
    extra = F.floor((F.col("_pos") + 1) * p + u) - F.floor(F.col("_pos") * p + u)
    return (
        joined.withColumn("_rate", rate)
        .withColumn("copies", (F.floor("_rate") + extra).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with ``mix_copy``
    (1, 2, ...; it replaces a column of that name). Rows that share a doc_id are told apart
    by source, size and a number."""
    num = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    counted = copies(sized(docs), **params)
    same = ["doc_id", "source", "size"]
    taken = counted.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("copies")))
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in same], "_n", "copies").filter("copies > 0")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    own = own.withColumn("_m", F.row_number().over(num))
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
    out = own.join(taken, on & (F.col("size") == F.col("_size")) & (F.col("_m") == F.col("_n")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = [c for c in docs.columns if c != "mix_copy"]
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_copy").alias("mix_copy"))


SIZE_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
#: Levels are tried at every source's ratio of cap to weight; the first that caps no more is the result.
TARGET_SQL = rf"""
sized AS (SELECT doc_id, source, {SIZE_SQL} AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
  [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sized GROUP BY source),
ordered AS (SELECT *, 2 * source_size AS cap,
  coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY 2 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM src),
level AS (SELECT min_by((150 * total::DOUBLE / 100 - capped::DOUBLE) / open::DOUBLE, capped) AS lev FROM ordered, (SELECT sum(source_size) AS total FROM src)
  WHERE (150 * total::DOUBLE / 100 - capped::DOUBLE) / open::DOUBLE * w <= cap),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(lev, 0) * w) AS target FROM ordered, level),
"""
MIX_SQL = rf"""
WITH {TARGET_SQL.strip()}
placed AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
  row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5('mix-1:' || s.doc_id), s.doc_id) - 1 AS pos,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(s.source, chr(0))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + floor((pos + 1) * (rate - floor(rate)) + u) - floor(pos * (rate - floor(rate)) + u)))::BIGINT AS taken
FROM placed"""


@query("op8_mixing", MIX_SQL)
def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by source weight; a digest of ``copies``."""
    out = copies(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
