"""Merkle manifest of a table with inclusion proofs (operator 13).

H is the lowercase hex SHA-256 of its inputs concatenated, digests as hex text. A leaf is H
of the row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The
leaves of a language ascend by id; every ``ARITY`` consecutive nodes become their H until
one is left, the language's subroot; subroots, ordered by language, become the root alike.

Every level is an equi-join of the node table with itself: a node of slot s names the index
of its run's slot zero (own index less s), slot-zero rows meet their siblings there and
emit the parent. No node carries more than one run, so a language with a third of all rows
is spread like any other. Proofs come back from the root: a run hands the runs above it to its
members, and only rows of one level meet in a join. A level is written to the shared
folder, so the work after a lost executor is a level's at most.

DataFrame functions only. Defined results: nulls are fields ``-`` (an empty text is ``0:``);
a null id comes first in its language and is never tampered with; rows of equal id are
ordered by leaf, so repeated rows are leaves of their own; one row alone is its own subroot
and root with an empty proof (the H of nothing); an empty table gives an empty result;
other columns pass through ``manifest`` unread, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import global_rank
from .registry import query
from .text import staged, table

ARITY = 8
#: Hex digits of a digest.
HEX = 64
#: One row in so many is tampered with, by the CRC-32 of its id.
TAMPERED = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Translation that lower-cases A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes (grp, idx, digest) with idx from 0 without gaps to (runs by level, roots by group).

    A run is (grp, first, size, run): the index of its slot zero, its number of members and
    their digests in order. A run alone with one member is its group's root.
    """
    runs, ends = [], []
    while True:
        slot = F.pmod("idx", F.lit(ARITY)).cast("int")
        zero = nodes.filter(slot == 0).select("grp", F.col("idx").alias("first"))
        members = nodes.select("grp", (F.col("idx") - slot).alias("first"), slot.alias("slot"), "digest")
        met = zero.join(members, ["grp", "first"]).groupBy("grp", "first").agg(
            F.count(F.lit(1)).cast("int").alias("size"), F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("_in")
        )
        level = staged(met.select("grp", "first", "size", F.array_join(F.transform("_in", lambda m: m["digest"]), "").alias("run")))
        alone = (F.col("first") == 0) & (F.col("size") == 1)
        ends.append(level.filter(alone).select("grp", F.col("run").alias("digest"), F.lit(len(runs)).alias("level")))
        level = level.filter(~alone)
        if level.isEmpty():
            return runs, reduce(DataFrame.unionByName, ends)
        runs.append(level)
        nodes = level.select("grp", (F.col("first") / ARITY).cast("long").alias("idx"), F.sha2("run", 256).alias("digest"))


def under_runs(runs: list[DataFrame], tails: DataFrame) -> DataFrame:
    """The runs of the lowest level with all runs above: (grp, first, run, up, tag).

    ``tails`` (grp, level, up, tag): the level of each group's root, the runs above that root
    and anything the rows of the group are to carry. ``up`` lists (run, slot) from the level
    above to the last. A group whose only leaf is its root has no run.
    """
    known = None
    for n in range(len(runs) - 1, -1, -1):
        at_end = tails.filter(F.col("level") == n + 1).select("grp", F.lit(0).cast("long").alias("idx"), "up", "tag")
        known = at_end if known is None else known.unionByName(at_end)
        met = runs[n].withColumn("idx", (F.col("first") / ARITY).cast("long")).join(known, ["grp", "idx"])
        if n:
            met = staged(met.select("grp", "first", "size", "run", "up", "tag"))
            slots = F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("slot")
            known = met.select("*", slots).select("grp", (F.col("first") + F.col("slot")).alias("idx"), path("up").alias("up"), "tag")
    return met.select("grp", "first", "run", "up", "tag")


def path(up: str) -> Column:
    """The runs from a member's own (columns run and slot) to the last."""
    return F.concat(F.array(F.struct("run", "slot")), F.col(up))


def siblings(runs: Column) -> Column:
    """The other members' digests of each run of a path, left to right, as one string."""
    before = lambda e: F.substring(e["run"], F.lit(1), e["slot"] * HEX)
    after = lambda e: F.substring(e["run"], (e["slot"] + 1) * HEX + 1, F.lit(ARITY * HEX))
    return F.array_join(F.transform(runs, lambda e: F.concat(before(e), after(e))), "")


def fold(leaf: Column, runs: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(runs, leaf, lambda acc, e: F.sha2(F.overlay(e["run"], acc, e["slot"] * HEX + 1, F.lit(HEX)), 256))


def _slots(df: DataFrame) -> DataFrame:
    slot = F.pmod("idx", F.lit(ARITY)).cast("int")
    return df.withColumn("slot", slot).withColumn("first", F.col("idx") - F.col("slot"))


def manifest(rows: DataFrame, key: str, group: str, leaf: Column, presented: Column) -> DataFrame:
    """Per row: the key, leaf, subroot, root, proof (siblings as one string) and folded_root.

    ``presented`` is the leaf folded with the original siblings: equal to ``leaf`` unless
    the row was tampered with.
    """
    grp = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    # Written before they are ranked, as ranges are sampled first: texts are read once.
    leaves = staged(rows.select(F.col(key).alias("key"), grp.alias("grp"), leaf.alias("leaf"), presented.alias("seen")))
    leaves = _slots(staged(global_rank(leaves, ["key", "leaf"], ["grp"], "idx")))
    runs, subroots = levels(leaves.select("grp", "idx", F.col("leaf").alias("digest")))
    ranked = _slots(staged(global_rank(subroots.withColumnRenamed("grp", "lang"), ["lang"], (), "idx")))
    top_runs, root = levels(ranked.select(F.lit("").alias("grp"), "idx", "digest"))
    none = F.expr("CAST(array() AS array<struct<run: string, slot: int>>)")
    tag = lambda r: F.struct(F.col("digest").alias("subroot"), F.col(r).alias("root")).alias("tag")
    if top_runs:
        top = under_runs(top_runs, root.select("grp", "level", none.alias("up"), F.col("digest").alias("tag")))
        at = ranked.join(top.withColumnRenamed("tag", "root"), "first").select(F.col("lang").alias("grp"), "level", path("up").alias("up"), tag("root"))
    else:
        at = ranked.select(F.col("lang").alias("grp"), "level", none.alias("up"), tag("digest"))
    tails = staged(at)
    out = leaves.filter("idx = 0").join(tails.filter("level = 0"), "grp").select("key", "leaf", "seen", "tag", F.col("up").alias("runs"))
    if runs:
        inner = leaves.join(under_runs(runs, tails), ["grp", "first"])
        out = out.unionByName(inner.select("key", "leaf", "seen", "tag", path("up").alias("runs")))
    return out.select(
        F.col("key").alias(key), "leaf", F.col("tag.subroot").alias("subroot"), F.col("tag.root").alias("root"),
        siblings(F.col("runs")).alias("proof"), fold(F.col("seen"), F.col("runs")).alias("folded_root"),
    )


#: CRC-32 of a decimal id bit by bit (polynomial 0xEDB88320).
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT FOR i IN range(8)]),
    lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
MANIFEST_SQL = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, lang, text, {CRC_SQL} % 3 = 0 AS tampered,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp,
  sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(text) || ':' || CASE WHEN tampered THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END, '-')) AS seen
  FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
low AS (SELECT grp, 0 AS level, idx, leaf AS digest, n FROM placed
  UNION ALL SELECT grp, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY grp, level, idx // 8, n),
subs AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, idx, digest, n FROM subs
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY level, idx // 8, n),
runs AS (SELECT grp, level, idx // 8 AS run, list(digest ORDER BY idx) AS members FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, level, idx // 8, list(digest ORDER BY idx) FROM high WHERE n > 1 GROUP BY ALL),
folded AS (SELECT doc_id, leaf, grp, grp AS own, 0 AS level, idx, seen AS acc, '' AS proof FROM placed
  UNION ALL SELECT f.doc_id, f.leaf, f.grp,
    CASE WHEN r.members IS NULL THEN NULL ELSE f.own END, CASE WHEN r.members IS NULL THEN 0 ELSE f.level + 1 END,
    CASE WHEN r.members IS NULL THEN s.idx ELSE f.idx // 8 END,
    CASE WHEN r.members IS NULL THEN f.acc ELSE sha256(array_to_string([CASE WHEN i - 1 = f.idx % 8 THEN f.acc ELSE m END FOR m, i IN r.members], '')) END,
    CASE WHEN r.members IS NULL THEN f.proof ELSE f.proof || array_to_string([m FOR m, i IN r.members IF i - 1 <> f.idx % 8], '') END
  FROM folded f LEFT JOIN runs r ON r.grp IS NOT DISTINCT FROM f.own AND r.level = f.level AND r.run = f.idx // 8
  LEFT JOIN subs s ON s.grp = f.own WHERE r.members IS NOT NULL OR f.own IS NOT NULL),
done AS (SELECT * FROM folded f WHERE own IS NULL AND level = (SELECT max(level) FROM high))
SELECT d.doc_id, d.leaf, s.digest AS subroot, h.digest AS root, sha256(d.proof) AS proof_sha256, d.acc AS folded_root, d.acc = h.digest AS verified
FROM done d JOIN subs s ON s.grp = d.grp, (SELECT digest FROM high WHERE n = 1) h"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents by language; a third of them is presented with lower-cased text."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    lowered = F.translate("text", UPPER, LOWER)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, lowered).otherwise(F.col("text"))
    out = manifest(docs, "doc_id", "lang", leaf_digest(fields), leaf_digest([*fields[:-1], changed]))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
