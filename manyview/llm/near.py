"""MinHash near-dedup with an LSH forest (operator 5).

Texts become sets of 64-bit hashes of five-word shingles; equal sets are one node. A node
has 128 minima, which the forest reads in several orders (trees). In the order of a tree,
nodes that share a prefix are neighbours; a *region* is a run of nodes with one prefix of
the tree's depth. Each level of the forest works in two steps:

1. Neighbours: in every region each node meets the node before it in signature order (the
   longest common prefix) and the region's centre. Its best partner of either kind is
   confirmed on the full sets. That is linear in the rows, however large a region is, and
   joins most of a group of near copies.
2. Rest: only regions whose nodes aren't all known to be connected are looked at again. Every
   pair of nodes not known to be is compared by signature; nodes with a possible link meet
   again in their cell with their full sets, where exact links are found by a matrix product
   and a spanning forest of them comes out. No list of pairs ever leaves a task.

Regions that are dense (more than ``REGION`` nodes) and still mixed after step 1 are not
compared at that depth: their nodes go down to the next level, where prefixes are longer and
trees so many that a pair at the threshold is missed as rarely as before. Regions are dealt
in cells of two blocks at most, so every case has its exact way in bounded memory.

A pair of similarity 0.75 shares a prefix of four in one of 32 trees but for 1 in 200,000;
the comparison of signatures passes 69 of 128 equal minima, which such a pair misses but for
1 in 10 million.

Defined results: null and empty texts have no shingles, are linked with nothing and kept;
rows without doc_id likewise; texts of fewer than five words have one shingle, the whole
sequence; repeated rows are exact copies (each has the same class and the same ``kept``);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .registry import query
from .text import mix, packed, pieces, powers, staged, table, unpacked, windows, words

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
MINIMA = 128
#: Equal minima of 128 that a pair needs to be confirmed on its full sets.
ALIKE = 69
#: (prefix length, trees) by level.
LEVELS = ((4, 32), (8, 192))
#: A mixed region of more nodes goes down a level; one of fewer is compared in blocks of BLOCK.
REGION = 8192
BLOCK = 1024
#: Bits of the broadcast marks of documents whose sets are read again.
MARK_BITS = 1 << 27

_FLIP = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)).astype(np.uint32)
_STEP = mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
#: Shingles that one step of the minima takes, so that they stay in the cache.
CHUNK = 1 << 15


def minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(set, MINIMA) 16-bit minima of the non-empty sets h[at[i]:at[i + 1]]."""
    n = len(at) - 1
    out = np.full((n, MINIMA), 0xFFFFFFFF, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n)
        part, starts = x[at[lo] : at[hi]], at[lo:hi] - at[lo]
        v = np.empty_like(part)
        for j in range(MINIMA):
            np.bitwise_xor(part, _FLIP[j], out=v)
            np.multiply(v, _STEP[j], out=v)
            out[lo:hi, j] = np.minimum.reduceat(v, starts)
        lo = hi
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their ranges."""
    h, at = windows(words(texts), SHINGLE, short=True)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    h = h.copy()
    for i in range(n):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=n))))


def set_digest(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit digest of each set, 0 for an empty one."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        s = at[:-1][some]
        out[some] = mix(np.add.reduceat(mix(h), s) + powers(3)[2] * np.bitwise_xor.reduceat(h, s) + n[some].astype(np.uint64))
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        h, at = shingle_sets(b.column("text"))
        n = np.diff(at)
        some = n > 0
        sig = np.zeros((len(n), MINIMA), np.uint16)
        if some.any():
            sig[some] = minima(h, np.append(at[:-1][some], len(h)))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(set_digest(h, at).view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
            ["doc_id", "n_shingles", "node", "sig"],
        )


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(set_digest(*shingle_sets(b.column("text"))).view(np.int64))], [*b.schema.names, "_node"])


def _matrix(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(-1, MINIMA)


def _order(level: int, tree: int) -> np.ndarray:
    """The positions of the signature in the order of a tree; its prefix comes first."""
    depth, trees = LEVELS[level]
    if depth * trees <= MINIMA:
        return np.roll(np.arange(MINIMA), -depth * tree)
    return np.argsort(mix(np.arange(MINIMA, dtype=np.uint64) + np.uint64(1 + level * 1_000_003 + tree * 1009)))


def _keys(level: int):
    """(node, sig) to one row (key, tree, node) for each tree of the level."""
    depth, trees = LEVELS[level]
    p = powers(depth + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column("sig")).astype(np.uint64)
            node = b.column("node").to_numpy(zero_copy_only=False)
            for t in range(trees):
                key = mix((mix(sig[:, _order(level, t)[:depth]] + np.uint64(1)) * p[1 : depth + 1]).sum(axis=1) + np.uint64(t))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(node), t, np.int32)), pa.array(node)], ["key", "tree", "node"])

    return run


def _ordered(level: int):
    """Adds the signature in the order of the row's tree as bytes that sort like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, tree = _matrix(b.column("sig")), b.column("tree").to_numpy()
            orders = np.stack([_order(level, t) for t in range(LEVELS[level][1])])
            turned = np.take_along_axis(sig, orders[tree], axis=1).astype(">u2")
            yield b.append_column("ord", pa.array([x.tobytes() for x in turned], pa.binary()))

    return run


def _alike(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows can be links by size and signature, and their equal minima."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    fits = np.flatnonzero(100 * small >= PERCENT * large)
    equal = np.zeros(len(i), np.int32)
    for lo in range(0, len(fits), 1 << 14):
        k = fits[lo : lo + (1 << 14)]
        equal[k] = np.count_nonzero(sig[i[k]] == sig[j[k]], axis=1)
    return equal >= ALIKE, equal


def _centre(sig: np.ndarray) -> int:
    """The row most like all: where most rows agree on a minimum, that is its median."""
    return int(np.count_nonzero(sig == np.partition(sig, len(sig) // 2, axis=0)[len(sig) // 2], axis=1).argmax())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, ord): each with the one before (kind 0) and with the centre of
    its region (kind 1), where they are alike. A region's centre is taken where it begins
    and kept to its end."""
    held = None  # (key, node, n, sig) of the region's centre and of the last row
    for b in batches:
        if b.num_rows == 0:
            continue
        key, node, n = (b.column(c).to_numpy() for c in ("key", "node", "n"))
        sig = _matrix(b.column("sig"))
        if held is not None:
            key, node, n = (np.concatenate((h, x)) for h, x in zip(held[:3], (key, node, n), strict=True))
            sig = np.concatenate((held[3], sig))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        centre = first.copy()
        for g in np.flatnonzero(size > 4):
            if g or held is None or key[0] != held[0][0]:
                centre[g] += _centre(sig[first[g] : first[g] + size[g]])
        i = np.setdiff1d(np.arange(len(key)), first, assume_unique=True)
        hub = np.repeat(centre, size)
        for kind, rows, other in ((0, i, i - 1), (1, np.arange(len(key)), hub)):
            keep, equal = _alike(sig, n, other, rows)
            keep &= node[rows] != node[other]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(keep.sum(), kind, np.int32)), pa.array(node[rows[keep]]), pa.array(node[other[keep]]), pa.array(equal[keep])], ["kind", "a", "b", "equal"]
            )
        ends = np.array([centre[-1], len(key) - 1])
        held = (key[ends], node[ends], n[ends], sig[ends])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells (key, lo, hi) of sorted rows, several at a time."""
    held: pa.Table | None = None
    for b in batches:
        for s in range(0, b.num_rows, 1024):
            part = pa.Table.from_batches([b.slice(s, 1024)])
            held = (part if held is None else pa.concat_tables([held, part])).combine_chunks()
            key, lo, hi = (held.column(c).to_numpy() for c in ("key", "lo", "hi"))
            other = np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
            if len(other):
                yield held.slice(0, other[-1] + 1).combine_chunks()
                held = held.slice(other[-1] + 1).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _same_cell(t: pa.Table) -> np.ndarray:
    """A number for each row's cell."""
    key, lo, hi = (t.column(c).to_numpy() for c in ("key", "lo", "hi"))
    return np.cumsum(np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))


def _live(level: int):
    """Rows with a partner in their cell that can be a link to another component. A pair
    counts in the first tree in whose regions it meets, and in one cell of a region."""
    depth, trees = LEVELS[level]
    orders = np.stack([_order(level, t)[:depth] for t in range(trees)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            cell, sig = _same_cell(t), _matrix(t.column("sig").combine_chunks())
            lo, hi, block, root, n, tree = (t.column(c).to_numpy() for c in ("lo", "hi", "block", "root", "n", "tree"))
            alive = np.zeros(len(cell), bool)
            i, shift = np.arange(len(cell) - 1), 1
            while True:
                i = i[i + shift < len(cell)]
                i = i[cell[i] == cell[i + shift]]
                if len(i) == 0:
                    break
                j = i + shift
                k = i[(root[i] != root[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))]
                k = k[_alike(sig, n, k, k + shift)[0]]
                k = k[~(alive[k] & alive[k + shift])]
                if len(k):
                    meets = (sig[k] == sig[k + shift])[:, orders].all(axis=2).argmax(axis=1)
                    k = k[meets == tree[k]]
                    alive[k] = alive[k + shift] = True
                shift += 1
            yield from t.filter(pa.array(alive)).select(["key", "lo", "hi", "node"]).to_batches()

    return run


def _cell_links(shingles: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the exact links between the sets: intersections are products of
    the incidence matrix over shingles that several sets have."""
    flat = shingles.flatten().to_numpy(zero_copy_only=False)
    n_of = np.diff(shingles.offsets.to_numpy())
    k = len(n_of)
    who = np.repeat(np.arange(k), n_of)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    some = count[inverse] > 1
    col, who = number[inverse[some]], who[some]
    both = np.zeros((k, k), np.float32)
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    width = 2048
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((k, width), np.float32)
        m[who[a:b], col[a:b] - lo] = 1
        both += m @ m.T
    link = 100 * both >= PERCENT * (n_of[:, None] + n_of[None, :] - both)
    np.fill_diagonal(link, False)
    left, a_out, b_out = np.ones(k, bool), [], []
    for s in range(k):
        if not left[s]:
            continue
        left[s], queue = False, [s]
        while queue:
            x = queue.pop()
            y = np.flatnonzero(link[x] & left)
            left[y] = False
            queue.extend(y.tolist())
            a_out += [x] * len(y)
            b_out += y.tolist()
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Live rows with their full sets to links that connect what is linked in each cell."""
    for t in _by_cell(batches):
        cell, node = _same_cell(t), t.column("node").to_numpy()
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sets = t.column("shingles").combine_chunks()
        for s, e in zip(first, np.append(first[1:], len(cell)), strict=True):
            a, b = _cell_links(sets.take(pa.array(np.arange(s, e))))
            yield pa.RecordBatch.from_arrays([pa.array(node[s + a]), pa.array(node[s + b])], ["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) that are links by their full shingle sets."""
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    met = pairs.join(b, "b").join(a, "a").withColumn("_i", F.size(F.array_intersect("_sa", "_sb")))
    return met.filter(100 * F.col("_i") >= PERCENT * (F.size("_sa") + F.size("_sb") - F.col("_i"))).select("a", "b")


def _labels(links: DataFrame, steps: int = 2) -> DataFrame:
    """(node, root) of the linked nodes, equal only where nodes are connected: the smallest node
    within ``steps`` links. A centre's group agrees after two; what doesn't is looked at again."""
    sym = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    label = sym.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    for _ in range(steps):
        around = sym.join(label.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), "root")
        label = around.unionByName(label).groupBy("node").agg(F.min("root").alias("root"))
    return label


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of every node."""
    found = connected_components(links, "a", "b")
    joined = nodes.select("node").join(found, "node", "left")
    return staged(joined.select("node", F.coalesce("root", "node").alias("root")))


def _slot(doc_id: np.ndarray, bits: int) -> np.ndarray:
    return (mix(doc_id.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _marks(docs: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit set over hashed doc_ids of ``docs``, at most MARK_BITS long. It only saves reading
    texts that aren't needed: rows that share a bit are sorted out by a join."""
    bits = min(MARK_BITS, max(1 << 16, 16 * count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for b in batches:
            seen[_slot(b.column("doc").to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["m"])

    parts = docs.select("doc").coalesce(64).mapInArrow(run, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r["m"]), np.uint8))
    return parts.treeAggregate(np.zeros((bits + 7) // 8, np.uint8), np.bitwise_or, np.bitwise_or, depth=2), bits


def _sets(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, bits = shared.value
        marks = np.unpackbits(packed)[:bits].astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(marks[_slot(batch.column("doc_id").to_numpy(), bits)]))
            for b in pieces(iter([some]), "text"):
                h, at = shingle_sets(b.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_digest(h, at).view(np.int64)), lists], ["node", "shingles"])

    return run


class _Forest:
    """The links between nodes (node, doc, n, sig), level by level."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), nodes
        self.links = nodes.sparkSession.createDataFrame([], "a long, b long")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(node, shingles) of the named nodes, from their documents' whole texts."""
        ids = staged(self.nodes.select("node", "doc").join(ids, "node", "left_semi"))
        marks = self.docs.sparkSession.sparkContext.broadcast(_marks(ids, ids.count()))
        made = self.docs.mapInArrow(_sets(marks), "node long, shingles array<long>")
        return staged(made.join(ids, "node", "left_semi").dropDuplicates(["node"]))

    def rows(self, nodes: DataFrame, level: int) -> DataFrame:
        """(key, tree, node, size) of nodes that share a region with others."""
        keyed = nodes.select("node", "sig").mapInArrow(_keys(level), "key long, tree int, node long")
        dense = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        return staged(keyed.join(dense, "key"))

    def meet(self, rows: DataFrame, nodes: DataFrame, level: int) -> None:
        """Step 1: each node with its best neighbour and its best centre."""
        turned = rows.join(nodes.drop("doc"), "node").mapInArrow(_ordered(level), "node long, key long, tree int, size long, n long, sig binary, ord binary")
        near = turned.repartitionByRange("key", "ord").sortWithinPartitions("key", "ord").select("key", "node", "n", "sig")
        met = near.mapInArrow(_neighbours, "kind int, a long, b long, equal int")
        best = met.groupBy("a", "kind").agg(F.max(F.struct("equal", "b")).alias("m"))
        pairs = staged(best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct())
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        self.links = staged(self.links.unionByName(confirmed(pairs, sets)))

    def level(self, nodes: DataFrame, level: int) -> DataFrame | None:
        """Adds the links found at this level; the nodes that need the next one."""
        rows = self.rows(nodes, level)
        self.meet(rows, nodes, level)
        rooted = rows.join(staged(_labels(self.links)), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key")
        left = staged(rooted.join(mixed, "key"))
        last = level + 1 == len(LEVELS)
        here = left if last else left.filter(F.col("size") <= REGION)
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        cells = (
            here.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("key", "tree", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        )
        cells = cells.join(nodes.drop("doc"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        live = staged(cells.select("key", "lo", "hi", "block", "root", "node", "n", "tree", "sig").mapInArrow(_live(level), "key long, lo int, hi int, node long"))
        sets = self.sets(live.select("node").distinct())
        full = live.join(sets, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        found = full.select("key", "lo", "hi", "node", "shingles").mapInArrow(_linked, "a long, b long")
        self.links = staged(self.links.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        return None if last else staged(nodes.join(left.filter(F.col("size") > REGION).select("node").distinct(), "node", "left_semi"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, node (digest of the shingle set; 0: none),
    n_shingles, component_id, kept."""
    own = docs.select("doc_id", "text")
    signed = staged(own.mapInArrow(_signed, "doc_id long, n_shingles long, node long, sig binary"))
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = staged(full.groupBy("node").agg(F.min("doc_id").cast("long").alias("doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    forest = _Forest(own.filter("doc_id IS NOT NULL"), nodes)
    todo = nodes
    for level in range(len(LEVELS)):
        if level and todo.isEmpty():
            break
        todo = forest.level(todo, level)
    roots = _roots(nodes, forest.links)
    first = nodes.select("node", "doc").join(roots, "node").groupBy("root").agg(F.min("doc").alias("component_id"))
    classes = roots.join(first, "root").select("node", "component_id")
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).otherwise(0).alias("node"))
    out = rows.join(classes, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class (the smallest doc_id; of repeated rows one).
    Rows without shingles stay, but rows alike in doc_id and all else count as one."""
    kept = near_classes(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("node").alias("_of")).distinct()
    rows = packed(docs, "doc_id", "text")
    noded = rows.mapInArrow(_noded, T.StructType([*rows.schema.fields, T.StructField("_node", T.LongType())]))
    noded = noded.withColumn("_node", F.when(F.col("doc_id").isNotNull(), F.col("_node")).otherwise(0))
    out = noded.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_of")))
    has = out.filter("_node <> 0").dropDuplicates(["doc_id", "_node"])
    return unpacked(has.unionByName(out.filter("_node = 0")), docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op5_minhash_near_dedup", NEAR_SQL)
def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
