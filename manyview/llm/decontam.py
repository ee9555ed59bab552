"""Benchmark decontamination (operator 4).

Windows as long as a benchmark item slide over the words of every whole text. A window and
an item get SimHash fingerprints of their words; a multi-index over the items' fingerprints
(``RADIUS`` + 1 blocks of bits, of which two fingerprints within the radius share at least
one) finds every item within the radius of a window, and such candidates are verified
exactly: the weighted Jaccard similarity of their shingles must reach 0.75. A shingle's
weight is 1 / (number of items that have it), so phrases of the benchmark's own form count
little.

Only windows that hold a shingle of the item whose length they have are fingerprinted: all
others have similarity 0. No radius holds every window that could be verified (words changed
in a row, or where the item's shingles weigh little, turn many bits), so windows that share
0.75 of an item's weight, without which they can't reach 0.75, are candidates at any distance.

The benchmark is broadcast in groups of at most ``GROUP_WORDS`` words; a larger one takes
several passes over the documents instead of a larger broadcast. Documents never shuffle.

Defined results: null and empty texts have no windows; a text shorter than an item is one
window for it (``LEAK_SQL`` has none there); items without words match nothing;
items of fewer than five words have one shingle, the whole item; repeated rows and
items are alike (ties go to the smaller item_id); a row without doc_id is treated like any
other; an empty benchmark leaves all documents clean; other columns pass through (one
named ``_leak`` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query
from .text import mix, packed, pieces, powers, table, unpacked, windows, words

SHINGLE = 5
SIMILAR = 0.75
#: Hamming distance of 64-bit fingerprints of words. Windows with two or three scattered words
#: of 40 changed are at 6 bits, 2.3 up or down; see ``heavy`` for those further away.
RADIUS = 15
#: Words of the benchmark that one broadcast holds.
GROUP_WORDS = 2_000_000

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_items", T.LongType())])


def _signs(h: np.ndarray) -> np.ndarray:
    """(word, 64) of -1 and 1."""
    bits = np.unpackbits(mix(h ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows h[start:start + size]; a tied bit is 0."""
    run = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(_signs(h), axis=0)))
    return np.packbits(run[start + size] - run[start] > 0, axis=1).view(np.uint64).ravel()


class Items:
    """A group of benchmark items as arrays: shingles, weights, fingerprints and the multi-index."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words(pa.array(texts, pa.string()))
        g, at = windows(w, SHINGLE, short=True)
        keep = np.flatnonzero(w.count > 0)
        self.ids, self.size = np.array(ids, np.int64)[keep], w.count[keep]
        sets = [np.unique(g[at[i] : at[i + 1]]) for i in keep]
        self.shingle, inverse, items = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        self.weight = 1.0 / np.maximum(items, 1)
        item = np.repeat(np.arange(len(keep)), [len(s) for s in sets])
        order = np.lexsort((item, inverse))
        self.has, self.has_at = item[order], np.concatenate(([0], np.cumsum(items)))  # items of each shingle
        self.of = [inverse[item == k] for k in range(len(keep))] if len(keep) < 2 else np.split(inverse, np.flatnonzero(np.diff(item)) + 1)
        self.total = np.array([self.weight[x].sum() for x in self.of])
        self.short = np.unique(self.size[self.size < SHINGLE])
        self.maybe = np.zeros(1 << 20, bool)  # a first look by 20 bits of the hash
        self.maybe[(self.shingle >> np.uint64(44)).astype(np.int64)] = True
        self.print_ = np.array([fingerprints(w.hash[w.at[i] : w.at[i + 1]], np.zeros(1, np.int64), int(w.count[i]))[0] for i in keep], np.uint64)
        edges = np.linspace(0, 64, RADIUS + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            shift, mask = np.uint64(lo), np.uint64((1 << int(hi - lo)) - 1)
            value = ((self.print_ >> shift) & mask).astype(np.int64)
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange(int(mask) + 2))
            self.blocks.append((shift, mask, order, start))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among hashes that are benchmark shingles, and which."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.shingle, h[at]), max(len(self.shingle) - 1, 0))
        hit = self.shingle[k] == h[at] if len(self.shingle) else np.zeros(len(at), bool)
        return at[hit], k[hit]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for every item within the radius: candidates share a block."""
        win, item = [], []
        for shift, mask, order, start in self.blocks:
            v = ((prints >> shift) & mask).astype(np.int64)
            n = start[v + 1] - start[v]
            i = np.repeat(np.arange(len(prints)), n)
            j = order[np.repeat(start[v] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[i] ^ self.print_[j]) <= RADIUS
            win.append(i[near])
            item.append(j[near])
        pairs = np.unique(np.concatenate(win).astype(np.int64) * len(self.ids) + np.concatenate(item))
        return pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)

    def similarity(self, own: np.ndarray, n_other: int, k: int) -> float:
        """Weighted Jaccard of item k and a window with the benchmark shingles ``own`` and
        ``n_other`` distinct shingles that no item has (they weigh 1)."""
        both = self.weight[own[np.isin(own, self.of[k])]].sum()
        return float(both / (self.weight[own].sum() + n_other + self.total[k] - both))


def heavy(items: Items, at: np.ndarray, owner: np.ndarray, which: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) for every window of a text of n words that shares enough weight to reach
    SIMILAR; for items longer than the text, the whole text is the window.

    ``at``, ``owner`` and ``which`` are the places of shingles in the text, an item that has
    the shingle, and the shingle. A shingle found twice counts twice, so this is a bound.
    """
    win, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.lexsort((at, owner))
    at, owner, which = at[order], owner[order], which[order]
    enough = SIMILAR * items.total - 1e-9
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sums = np.add.reduceat(items.weight[which], first) if len(first) else np.zeros(0)
    for j in np.flatnonzero(sums >= enough[owner[first]]).tolist():
        k, own = owner[first[j]], slice(first[j], first[j + 1] if j + 1 < len(first) else len(owner))
        length, w = min(int(items.size[k]), n), items.weight[which[own]]
        # A shingle's weight comes in at the first window that holds it and goes after the last.
        lo, hi = np.maximum(at[own] - length + width, 0), np.minimum(at[own], n - length) + 1
        edge, where = np.unique(np.concatenate((lo, hi)), return_inverse=True)
        run = np.cumsum(np.bincount(where, np.concatenate((w, -w))))
        for e in np.flatnonzero(run >= enough[k]).tolist():
            win.append(np.arange(edge[e], edge[e + 1]))
            item.append(np.full(edge[e + 1] - edge[e], k))
    return np.concatenate(win), np.concatenate(item)


def _text_leaks(items: Items, h: np.ndarray, g: np.ndarray) -> list[tuple[int, float, int]]:
    """(item, similarity, first word) of the best window for each item found in one text."""
    n = len(h)
    looks = [(SHINGLE, *items.find(g))]
    for size in items.short[items.short <= n].tolist():
        part = h[: n - size + 1] * powers(SHINGLE + 1)[1]
        for j in range(1, size):
            part = part + h[j : n - size + 1 + j] * powers(SHINGLE + 1)[1 + j]
        looks.append((size, *items.find(mix(part + np.uint64(size)))))
    best: dict[int, tuple[float, int]] = {}
    for width, pos, which in looks:
        if len(pos) == 0:
            continue
        # The lengths worth a look: those of the items that have one of the shingles found.
        many = items.has_at[which + 1] - items.has_at[which]
        owner = items.has[np.repeat(items.has_at[which] - np.concatenate(([0], np.cumsum(many)))[:-1], many) + np.arange(many.sum())]
        at, size = np.repeat(pos, many), items.size[owner]
        ok = (size >= SHINGLE) if width == SHINGLE else (size == width)
        win, item = heavy(items, at[ok], owner[ok], np.repeat(which, many)[ok], width, n)
        ok &= size <= n
        pairs = [win * len(items.ids) + item]
        for length in np.unique(size[ok]).tolist():
            near = np.unique(at[ok & (size == length)])
            lo, hi = np.maximum(near - length + width, 0), np.minimum(near, n - length)
            step = np.zeros(n - length + 2, np.int64)
            np.add.at(step, lo[lo <= hi], 1)
            np.add.at(step, hi[lo <= hi] + 1, -1)
            start = np.flatnonzero(np.cumsum(step)[:-1] > 0)
            for s in np.split(start, np.flatnonzero(np.diff(start) > 1) + 1):
                if len(s) == 0:
                    continue
                win, item = items.within(fingerprints(h[s[0] : s[-1] + length], s - s[0], length))
                fits = items.size[item] == length
                pairs.append(s[win[fits]] * len(items.ids) + item[fits])
        for pair in np.unique(np.concatenate(pairs)).tolist():
            i, k = divmod(pair, len(items.ids))
            if width == SHINGLE:
                shingles = np.unique(g[i : i + items.size[k] - SHINGLE + 1])
                at_, own = items.find(shingles)
                sim = items.similarity(own, len(shingles) - len(own), k)
            else:
                hit = np.flatnonzero(pos == i)
                sim = items.similarity(which[hit[:1]], 0, k) if len(hit) else 0.0
            if sim >= SIMILAR and (k not in best or sim > best[k][0]):
                best[k] = (sim, i)
    return [(int(items.ids[k]), s, i) for k, (s, i) in best.items()]


def _leaks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in pieces(batches, "text"):
            w = words(b.column("text"))
            g, at = windows(w, SHINGLE)
            pos, _ = items.find(g)
            doc = set((np.searchsorted(at, pos, "right") - 1).tolist())
            if len(items.short):
                doc |= set(np.flatnonzero(w.count > 0).tolist())
            found: list[dict | None] = [None] * b.num_rows
            for i in sorted(doc):
                got = _text_leaks(items, w.hash[w.at[i] : w.at[i + 1]], g[at[i] : at[i + 1]])
                if got:
                    k, sim, first = min(got, key=lambda x: (-x[1], x[0]))
                    found[i] = {"item_id": k, "similarity": sim, "first_word": first, "n_items": len(got)}
            kind = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_items", pa.int64())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, "_leak"])

    return run


def _groups(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in groups that fit a broadcast, in order of item_id."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").dropna().distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if texts and size + n > GROUP_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if texts:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the struct ``_leak`` of the best item (item_id, similarity, first_word)
    and the number of items found; null where none is."""
    sc = docs.sparkSession.sparkContext
    out = packed(docs, "text").withColumn("_leak", F.lit(None).cast(LEAK))
    for group in _groups(benchmark):
        before = out.withColumnRenamed("_leak", "_before")
        now = before.mapInArrow(_leaks(sc.broadcast(group)), T.StructType([*before.schema.fields, T.StructField("_leak", LEAK)]))
        better = (F.col("_leak.similarity") > F.col("_before.similarity")) | F.col("_before").isNull()
        both = F.when(better, F.col("_leak")).otherwise(F.col("_before"))
        total = (F.coalesce("_leak.n_items", F.lit(0)) + F.coalesce("_before.n_items", F.lit(0))).cast("long")
        one = F.struct(both["item_id"].alias("item_id"), both["similarity"].alias("similarity"), both["first_word"].alias("first_word"), total.alias("n_items"))
        out = now.withColumn("_leak", F.when(both.isNotNull(), one)).drop("_before")
    return unpacked(out, [c for c in docs.columns if c != "_leak"], F.col("_leak"), text=F.col("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leaked item, with their columns as they were."""
    return leaks(docs, benchmark).filter("_leak IS NULL").drop("_leak")


LEAK_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM dw WHERE len(w) >= 5),
bg AS (SELECT DISTINCT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM bw WHERE len(w) >= 5),
wt AS (SELECT g, 1.0::DOUBLE / count(*) AS weight FROM bg GROUP BY g),
it AS (SELECT item_id, any_value(n) AS n, sum(weight) AS total FROM bg JOIN wt USING (g) GROUP BY item_id),
hit AS (SELECT doc_id, p, item_id, n FROM dg JOIN bg USING (g)),
len AS (SELECT doc_id, max(p) AS last FROM dg GROUP BY doc_id),
win AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(greatest(p - n + 5, 1), least(p, last - n + 5) + 1)) AS s FROM hit JOIN len USING (doc_id)),
inside AS (SELECT DISTINCT win.doc_id, item_id, s, g FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.p BETWEEN s AND s + n - 5),
sim AS (SELECT doc_id, item_id, s, sum(CASE WHEN bg.g IS NOT NULL THEN weight ELSE 0 END) AS b, sum(coalesce(weight, 1)) AS t
  FROM inside LEFT JOIN wt USING (g) LEFT JOIN bg USING (item_id, g) GROUP BY 1, 2, 3),
ok AS (SELECT doc_id, item_id, max(b / (t + total - b)) AS v FROM sim JOIN it USING (item_id) WHERE b / (t + total - b) >= 0.75 GROUP BY 1, 2),
o AS (SELECT doc_id, arg_min(item_id, (-round(v, 9), item_id)) AS item_id, round(max(v), 6) AS similarity, count(*)::BIGINT AS n_items FROM ok GROUP BY doc_id)
SELECT d.doc_id, item_id, similarity, coalesce(n_items, 0)::BIGINT AS n_items, n_items IS NOT NULL AS contaminated
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id"""


@query("op4_decontamination", LEAK_SQL)
def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents with the benchmark item they hold, if any."""
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_leak.item_id").alias("item_id"),
        F.round("_leak.similarity", 6).alias("similarity"),
        F.coalesce("_leak.n_items", F.lit(0).cast("long")).alias("n_items"),
        F.col("_leak").isNotNull().alias("contaminated"),
    )
