"""Substring dedup by content-defined chunks (operator 2).

A gear hash rolls over the bytes of a text (h = (h << 2) + gear[byte], so it knows the last
16 bytes); a chunk ends where the hash is smaller than at the 15 bytes before and not larger
than at the 15 after. Cuts depend on the bytes around them alone, so an insertion moves the
cuts next to it and no others. Chunks of 16 bytes and more, 31 on average, are compared by
digest. A *passage* is a run of chunks that all stand in other documents too and that has
at least ``MIN_WORDS`` words; of a passage every chunk goes but at its first place, the
document with the smallest id.

Texts are dealt to blocks by hash. A block sends each distinct digest once, with its smallest
doc_id and whether several have it, cut into buckets by digest, so a passage that a third of all documents
share costs one entry per block. A bucket answers for each entry whether other documents
have the digest and whether the block has its first place; the block then cuts its texts.

Defined results: null and empty texts have no chunks and stay as they are; rows with one
doc_id are one document (what only they have isn't repeated "across documents", and repeated
rows fare alike); rows without doc_id count as one last document; texts without a cut are one chunk; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import SPACE, buffers, mix, pieces, powers, table

MIN_WORDS = 18
#: Bytes before and after a cut whose hashes it is compared with; at most 15, as the first
#: 15 bytes of a text have no full hash and so never cut, nor let texts look into each other.
REACH = 15
BLOCK_CHARS = 8_000_000
_NONE = np.iinfo(np.int64).max

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: 16 terms added up by doubling."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        out = h.copy()
        out[k:] += h[:-k] << np.uint32(2 * k)
        h = out
    return h


@dataclass
class Chunks:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    digest: np.ndarray


def chunks(raw: np.ndarray, offs: np.ndarray) -> Chunks:
    """The chunks of all texts of a buffer, in order."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return Chunks(none, none, none, np.zeros(0, np.uint64))
    top = np.uint32(0xFFFFFFFF)
    h = gear(raw)
    sizes = np.diff(offs)
    heads = np.repeat(offs[:-1], np.minimum(sizes, REACH))
    h[heads + _ramp(np.minimum(sizes, REACH))] = top
    h[:-1][(raw[1:] & 0xC0) == 0x80] = top  # only between characters
    low = np.concatenate((np.full(REACH, top), h, np.full(REACH, top)))
    for k in (1, 2, 4):
        low[k:] = np.minimum(low[k:], low[:-k].copy())
    low[REACH - 8 :] = np.minimum(low[REACH - 8 :], low[: len(low) - REACH + 8].copy())  # now of 15 values
    before, after = low[REACH - 1 : REACH - 1 + len(h)], low[2 * REACH :]
    cut = np.flatnonzero((h < before) & (h <= after) & (h != top)) + 1
    start = np.union1d(cut, offs[:-1][sizes > 0])
    start = start[start < len(raw)]
    end = np.append(start[1:], len(raw))
    span = end - start
    place = np.arange(len(raw)) - np.repeat(start, span)
    digest = mix(np.add.reduceat(_BYTES[raw] * powers(int(span.max()))[place], start) + span.astype(np.uint64))
    return Chunks(start, end, np.searchsorted(offs, start, "right") - 1, digest)


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _ordered(t: pa.Table) -> pa.Table:
    """The rows of a block in an order that both passes share."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _read(t: pa.Table) -> list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Chunks]]:
    out = []
    for b in t.to_batches():
        for p in pieces(iter([b]), "text"):
            raw, offs = buffers(p.column("text"))
            out.append((p, raw, offs, chunks(raw, offs)))
    return out


def _edges(digest: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted((digest >> np.uint64(32)).astype(np.int64) * buckets >> 32, np.arange(buckets + 1))


def _ids(p: pa.RecordBatch) -> np.ndarray:
    return p.column("doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def _sent(buckets: int):
    """A block to packed arrays of distinct digests, the smallest doc_id, and whether several documents have it."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        read = _read(_ordered(t))
        digest = np.concatenate([c.digest for *_, c in read])
        doc = np.concatenate([_ids(p)[c.doc] for p, _, _, c in read])
        order = np.argsort(digest, kind="stable")  # documents stand in order
        d, ids = digest[order], doc[order]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(d)) - 1 if len(d) else first
        u, lo, hi = d[first], ids[first], ids[last]
        edge = _edges(u, buckets)
        some = np.flatnonzero(edge[1:] > edge[:-1])
        pack = lambda x: pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary())
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), block, np.int64)), "d": pack(u), "lo": pack(lo), "several": pack((lo != hi).astype(np.uint8))})

    return run


def _answered(t: pa.Table) -> pa.Table:
    """A bucket's entries to flags: 1 if several documents have the digest, 2 if the block has its first place."""
    ds = [np.frombuffer(x, np.uint64) for x in t.column("d").to_pylist()]
    d = np.concatenate(ds)
    lo = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("lo").to_pylist()])
    several = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("several").to_pylist()])
    order = np.lexsort((lo, d))
    new = np.append(True, d[order][1:] != d[order][:-1])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = lo[order][at]
    most = lo[order][np.append(at[1:], len(d)) - 1]
    many = (np.maximum.reduceat(several[order], at) > 0) | (least != most)
    flags = np.empty(len(d), np.uint8)
    flags[order] = many[group].astype(np.uint8) + 2 * (lo[order] == least[group]).astype(np.uint8)
    ends = np.cumsum([0, *map(len, ds)])
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "flags": pa.array([flags[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _passages(c: Chunks, shared: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Which chunks lie in runs of shared chunks of enough words."""
    if len(c.start) == 0:
        return np.zeros(0, bool)
    new = np.ones(len(c.start), bool)
    new[1:] = (shared[1:] != shared[:-1]) | (c.doc[1:] != c.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    n = np.searchsorted(word_at, c.end[last]) - np.searchsorted(word_at, c.start[first])
    return np.repeat(shared[first] & (n >= MIN_WORDS), last - first + 1)


def _cut(t: pa.Table, answers: pa.Table) -> pa.Table:
    kind = {"doc_id": pa.int64(), "text": pa.string(), "n_chunks": pa.int64(), "repeated_words": pa.int64(), "removed_words": pa.int64()}
    if t.num_rows == 0:
        return pa.table({k: pa.array([], v) for k, v in kind.items()})
    order = np.argsort(answers.column("bucket").to_numpy())
    packed = answers.column("flags").to_pylist()
    flags = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(packed[i], np.uint8) for i in order)])
    read = _read(_ordered(t))
    u, at = np.unique(np.concatenate([c.digest for *_, c in read]), return_index=True)
    least = np.concatenate([_ids(p)[c.doc] for p, _, _, c in read])[at]  # documents stand in order
    out = []
    for p, raw, offs, c in read:
        k = np.searchsorted(u, c.digest)
        mine = flags[k] if len(k) else np.zeros(0, np.uint8)
        # The first place is the smallest doc_id's, and of its row the first one with the digest.
        first = (mine & 2 > 0) & (_ids(p)[c.doc] == least[k]) if len(k) else np.zeros(0, bool)
        once = np.zeros(len(k), bool)
        once[np.unique(mix(c.digest ^ mix(c.doc.astype(np.uint64))), return_index=True)[1]] = True
        first &= once
        inside = ~SPACE[raw]
        word = inside.copy()
        word[1:] &= ~inside[:-1]
        edge = offs[:-1][offs[:-1] < offs[1:]]
        word[edge] = inside[edge]
        word_at = np.flatnonzero(word)
        passage = _passages(c, mine & 1 > 0, word_at)
        gone = passage & ~first
        n_words = np.searchsorted(word_at, c.end) - np.searchsorted(word_at, c.start)
        per = lambda w, c=c, n=p.num_rows: np.bincount(c.doc, weights=w, minlength=n).astype(np.int64)
        texts = p.column("text").to_pylist()
        keep = np.repeat(~gone, c.end - c.start) if len(k) else np.zeros(0, bool)
        for i in np.unique(c.doc[gone]):
            texts[i] = raw[offs[i] : offs[i + 1]][keep[offs[i] : offs[i + 1]]].tobytes().decode()
        out.append(pa.table({"doc_id": p.column("doc_id"), "text": pa.array(texts, pa.string()), "n_chunks": per(None), "repeated_words": per(n_words * passage), "removed_words": per(n_words * gone)}))
    return pa.concat_tables(out).cast(pa.schema(list(kind.items())))


def dedup_passages(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text without repeated passages, n_chunks, repeated_words (in passages that other
    documents have too, first places included) and removed_words of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(_sent(blocks), "bucket int, block long, d binary, lo binary, several binary")
    answers = sent.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_answered, "block long, bucket int, flags binary")
    kind = "doc_id long, text string, n_chunks long, repeated_words long, removed_words long"
    return dealt.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(_cut, kind)


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chunks", "repeated_words", "removed_words", (F.col("repeated_words") > 0).alias("repeats"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
