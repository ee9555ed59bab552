"""Language-model scoring (operator 7): a hashed maximum-entropy model with class-factored softmax.

A token (word or end of text) belongs by its hash to one of 16 classes of 16 subclasses.
P(token | history) = P(class | history) P(subclass | class, history) P(token | subclass).
The first two are softmax over hashed features of the history: a bias, the word before,
the words two and three back (skips) and the pair before (n-gram). The last is the add-one
estimate within the subclass, the maximum-entropy model with one feature per token.

*Counts.* Texts are dealt to blocks by hash. A block gives its distinct token hashes and
training counts as sorted arrays, cut into buckets by hash; a bucket adds up all blocks'
arrays and returns each block its totals. What moves is one entry per block and distinct
token, in packed arrays, and every group is bounded: a block by its texts, a bucket by
the number of blocks and buckets, which both grow with the corpus.

*Training.* In every round each task takes AdaGrad steps over its share of the training
texts, starting from the broadcast weights, and returns the change of its weights; changes
are summed over tasks as a tree and averaged over the tasks that touched a feature. Weights
are (features + 1) * 272 numbers, whatever the corpus. Rounds take disjoint shares of the
training texts, so together they take each once.

*Scoring.* Blocks meet their totals in a cogroup and are scored in numpy batches.

Defined results: null and empty texts have one token, the end; repeated rows are scored
alike; a null doc_id is in training; without training texts every token has probability
one in the base score; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import mix, pieces, staged, table, words

HELD_OUT_MOD, HELD_OUT_REMAINDER = 7, 2
SIDE = 16
#: Hashed features by template: word before, two back, three back, pair before.
TEMPLATES = (2048, 1024, 512, 512)
FEATURES = sum(TEMPLATES) + 1
ROUNDS = 2
#: Slices of the weights that are summed apart, so that no task or driver sees more than one sum of each.
SLICES = 32
RATE = 0.25
#: Tokens of a gradient step and of a scoring step.
STEP = 1 << 15
#: Text of a block, in characters.
BLOCK_CHARS = 8_000_000

END, START = np.uint64(0x9D2C5680A5B1F0E3), np.uint64(0x1F83D9ABFB41BD6B)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text with its end, and the ranges of the texts."""
    w = words(texts)
    return np.insert(w.hash, w.at[1:], END), w.at + np.arange(len(w.at))


def features(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(token, 5) feature numbers of the histories."""
    start = at[:-1]

    def back(k: int) -> np.ndarray:
        p = np.empty_like(h)
        p[:k] = START
        p[k:] = h[:-k] if k < len(h) else h[:0]
        for j in range(k):
            s = start + j
            p[s[s < at[1:]]] = START
        return p

    one, two, three = back(1), back(2), back(3)
    out, first = np.zeros((len(h), 5), np.int32), 1
    sources = (one + np.uint64(1), two + np.uint64(2), three + np.uint64(3), one * np.uint64(0x9E3779B97F4A7C15) + two)
    for j, (x, size) in enumerate(zip(sources, TEMPLATES, strict=True)):
        out[:, j + 1] = first + (mix(x) % np.uint64(size)).astype(np.int32)
        first += size
    return out


def classes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = (h & np.uint64(255)).astype(np.int32)
    return k >> 4, k & 15


class Weights:
    """Class weights (feature, 16) and subclass weights (feature, class, 16)."""

    def __init__(self, top: np.ndarray, sub: np.ndarray):
        self.top, self.sub = top, sub

    @classmethod
    def unigram(cls, totals: np.ndarray) -> Weights:
        """Weights whose bias gives the classes' shares of the training tokens."""
        top, sub = np.zeros((FEATURES, SIDE), np.float32), np.zeros((FEATURES, SIDE, SIDE), np.float32)
        n = totals.reshape(SIDE, SIDE) + 1.0
        top[0] = np.log(n.sum(axis=1) / n.sum())
        sub[0] = np.log(n / n.sum(axis=1, keepdims=True))
        return cls(top, sub)

    def logits(self, f: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z1, z2 = self.top[f[:, 0]], self.sub[f[:, 0], k1]
        for j in range(1, f.shape[1]):
            z1 = z1 + self.top[f[:, j]]
            z2 = z2 + self.sub[f[:, j], k1]
        return z1, z2

    def log_classes(self, f: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Natural log of P(class) P(subclass | class)."""
        rows = np.arange(len(f))
        out = np.zeros(len(f))
        for z, k in zip(self.logits(f, k1), (k1, k2), strict=True):
            z -= z.max(axis=1, keepdims=True)
            out += z[rows, k] - np.log(np.exp(z).sum(axis=1))
        return out


def _softmax_less_hit(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), k] -= 1
    return z


def train(weights: Weights, steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[Weights, np.ndarray]:
    """AdaGrad over steps of (features, token hashes); the weights and which features were seen."""
    top, sub = weights.top.copy(), weights.sub.copy()
    now = Weights(top, sub)
    seen = np.zeros(FEATURES, np.float32)
    sums = (np.full(top.size, 1e-8, np.float32), np.full(sub.size, 1e-8, np.float32))
    side = np.arange(SIDE)
    for f, h in steps:
        k1, k2 = classes(h)
        z1, z2 = now.logits(f, k1)
        g1, g2 = _softmax_less_hit(z1, k1), _softmax_less_hit(z2, k2)
        seen[f.ravel()] = 1
        for w, g, base, total in ((top, g1, f, sums[0]), (sub, g2, f * SIDE + k1[:, None], sums[1])):
            grad = np.zeros(w.size)
            for j in range(f.shape[1]):
                at = base[:, j, None] * SIDE + side
                grad += np.bincount(at.ravel(), weights=g.ravel(), minlength=w.size)
            grad = (grad / len(h)).astype(np.float32)
            total += grad * grad
            w -= (RATE * grad / np.sqrt(total)).reshape(w.shape)
    return now, seen


def _trained(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value

        def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            n = 0
            for b in pieces(batches, "text"):
                h, at = tokens(b.column("text"))
                f = features(h, at)
                held.append((f, h))
                n += len(h)
                if n < STEP:
                    continue
                f, h = (np.concatenate(x) for x in zip(*held, strict=True))
                for lo in range(0, n - STEP + 1, STEP):
                    yield f[lo : lo + STEP], h[lo : lo + STEP]
                rest = n - n % STEP
                held, n = [(f[rest:], h[rest:])], n % STEP
            if n:
                f, h = (np.concatenate(x) for x in zip(*held, strict=True))
                yield f, h

        now, seen = train(weights, steps())
        if seen.any():
            flat = np.concatenate(((now.top - weights.top).ravel(), (now.sub - weights.sub).ravel(), seen)).astype(np.float32)
            parts = [x.tobytes() for x in np.array_split(flat, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], ["slice", "change"])

    return run


def fit(docs: DataFrame, class_totals: np.ndarray) -> Weights:
    """Weights trained on the training rows of ``docs`` (doc_id, text, held_out)."""
    sc = docs.sparkSession.sparkContext
    weights = Weights.unigram(class_totals)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    for r in range(ROUNDS):
        part = docs.filter(~F.col("held_out") & (share == r)).select("text")
        changes = part.mapInArrow(_trained(sc.broadcast(weights)), "slice int, change binary").rdd
        slices = changes.map(lambda row: (row["slice"], np.frombuffer(bytes(row["change"]), np.float32)))
        sums = dict(slices.reduceByKey(np.add, numPartitions=SLICES).collect())
        if not sums:
            continue
        total = np.concatenate([sums[k] for k in range(SLICES)])
        n_top, n_sub = FEATURES * SIDE, FEATURES * SIDE * SIDE
        seen = np.maximum(total[n_top + n_sub :], 1)
        weights = Weights(
            weights.top + total[:n_top].reshape(FEATURES, SIDE) / seen[:, None],
            weights.sub + total[n_top : n_top + n_sub].reshape(FEATURES, SIDE, SIDE) / seen[:, None, None],
        )
    return weights


def _counted(buckets: int):
    """A block's texts to packed arrays of token hashes and training counts by bucket."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for held_out in (False, True):
            hs = [tokens(p.column("text"))[0] for b in t.filter(pa.compute.equal(t.column("held_out"), held_out)).to_batches() for p in pieces(iter([b]), "text")]
            if hs:
                u, c = np.unique(np.concatenate(hs), return_counts=True)
                both, inverse = np.unique(np.concatenate((found, u)), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate((counts, c * (not held_out))), minlength=len(both)).astype(np.int64)
                found = both
        edge = _edges(found, buckets)
        some = np.flatnonzero(edge[1:] > edge[:-1])
        return pa.table(
            {
                "bucket": pa.array(some.astype(np.int32)),
                "block": pa.array(np.full(len(some), block, np.int64)),
                "h": pa.array([found[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary()),
                "c": pa.array([counts[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary()),
            }
        )

    return run


def _edges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes: buckets are equal ranges of the top 32 bits."""
    return np.searchsorted((h >> np.uint64(32)).astype(np.int64) * buckets >> 32, np.arange(buckets + 1))


def _added(t: pa.Table) -> pa.Table:
    """A bucket's arrays of all blocks to each block's totals; with block -1, the bucket's
    training tokens and distinct ones by subclass."""
    hs = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
    u, inverse = np.unique(np.concatenate(hs), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, np.int64) for x in t.column("c").to_pylist()])).astype(np.int64)
    ends = np.cumsum([0, *map(len, hs)])
    own = total[inverse].astype(np.int64)
    k = (u & np.uint64(255)).astype(np.int64)
    sums = np.concatenate((np.bincount(k, weights=total, minlength=256), np.bincount(k, weights=total > 0, minlength=256))).astype(np.int64)
    return pa.table(
        {
            "block": pa.array([*t.column("block").to_pylist(), -1], pa.int64()),
            "bucket": pa.array([*t.column("bucket").to_pylist(), -1], pa.int32()),
            "totals": pa.array([*(own[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)), sums.tobytes()], pa.binary()),
        }
    )


def _scored(shared):
    def run(t: pa.Table, counts: pa.Table) -> pa.Table:
        weights, sums = shared.value
        n_sub, v_sub = sums[:256], sums[256:]
        n, v = int(n_sub.sum()), int(v_sub.sum())
        order = np.argsort(counts.column("bucket").to_numpy())
        packed = counts.column("totals").to_pylist()
        c_of = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(packed[i], np.int64) for i in order)])
        if t.num_rows == 0:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{x: pa.array([], pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")}, **{x: pa.array([], pa.float64()) for x in ("base_score", "score")}})
        parts = [p for b in t.to_batches() for p in pieces(iter([b]), "text")]
        read = [tokens(p.column("text")) for p in parts]
        u = np.unique(np.concatenate([h for h, _ in read]))
        out: list[list[np.ndarray]] = []
        for h, at in read:
            c = c_of[np.searchsorted(u, h)]
            k = (h & np.uint64(255)).astype(np.int64)
            base = np.log10((c + 1) / (n + v + 1))
            own = np.log10((c + 1) / (n_sub[k] + v_sub[k] + 1))
            f, (k1, k2) = features(h, at), classes(h)
            for lo in range(0, len(h), STEP):
                s = slice(lo, lo + STEP)
                own[s] += weights.log_classes(f[s], k1[s], k2[s]) / np.log(10)
            out.append([np.diff(at), np.add.reduceat((c > 0).astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(own, at[:-1])])
        size, known, base, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": size, "n_known": known, "train_tokens": np.full(len(size), n), "base_score": base, "score": score})

    return run


def held_out(doc_id: Column) -> Column:
    r = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_MOD))
    return F.coalesce(r == HELD_OUT_REMAINDER, F.lit(False))


def score_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    chars = own.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")
    counted = dealt.groupBy("block").applyInArrow(_counted(blocks), "bucket int, block long, h binary, c binary")
    totals = staged(counted.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_added, "block long, bucket int, totals binary"))
    each = totals.filter("block = -1").select("totals").rdd.map(lambda r: (0, np.frombuffer(bytes(r["totals"]), np.int64)))
    sums = dict(each.reduceByKey(np.add, numPartitions=1).collect()).get(0, np.zeros(512, np.int64))
    weights = fit(own, sums[:256])
    score = _scored(spark.sparkContext.broadcast((weights, sums)))
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(totals.filter("block >= 0").repartition(blocks, "block").groupBy("block")).applyInArrow(score, kind)


@query("op7_lm_score")
def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
