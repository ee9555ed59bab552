"""Shared text helpers: word and line hashes over Arrow batches, and staged tables.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. In UTF-8
these are single bytes that occur in no other character, so words are cut on the
byte buffers of an Arrow batch and hashed there, without a Python object per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The word pattern for JVM expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step takes at most (a single longer text is one step).
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _byte_values(lower: bool) -> np.ndarray:
    v = mix((np.arange(1, 257, dtype=np.uint64)) * _BASE)
    v[SPACE] = 0
    return v[_LOWER] if lower else v


_VALUES = {True: _byte_values(True), False: _byte_values(False)}
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), np.uint64(0xD6E8FEB86659FD93))
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of text or one text."""
    for batch in batches:
        _, offs = buffers(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
            yield batch.slice(lo, min(hi, n) - lo)
            lo = hi


@dataclass
class Words:
    """All words of a batch in order: byte ranges, 64-bit hashes, and each text's range."""

    raw: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray  # word range of text i: at[i] .. at[i + 1]

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.count)


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Cut and hash the words of a batch; with ``lower`` A-Z count as a-z."""
    raw, offs = buffers(texts)
    none = np.zeros(0, np.int64)
    if len(raw) == 0:
        return Words(raw, offs, none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[:-1][offs[:-1] < offs[1:]]  # first byte of each text that has any
    first[edge] = inside[edge]
    last[edge[1:] - 1] = inside[edge[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(start) == 0:
        return Words(raw, offs, none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    span = np.diff(np.append(start, len(raw)))
    place = np.arange(start[0], len(raw)) - np.repeat(start, span)
    h = np.add.reduceat(_VALUES[lower][raw[start[0] :]] * powers(int(span.max()))[place], start - start[0])
    return Words(raw, offs, start, end, mix(h), np.searchsorted(start, offs))


def windows(w: Words, n: int = 5, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words and the window range of each text.

    With ``short``, a text of fewer words (but at least one) has one window: all of it.
    """
    n_words = w.count
    total = len(w.hash)
    if total < n:
        full = np.zeros(0, np.uint64)
    else:
        full = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            full += w.hash[k : total - n + 1 + k] * powers(n + 1)[n - k]
        full = mix(full)
    many = np.maximum(n_words - n + 1, 0)
    brief = short & (n_words > 0) & (n_words < n)
    many_out = many + brief
    at = np.concatenate(([0], np.cumsum(many_out)))
    out = np.zeros(at[-1], np.uint64)
    take = np.repeat(w.at[:-1] - np.concatenate(([0], np.cumsum(many)))[:-1], many) + np.arange(many.sum())
    out[np.repeat(~brief, many_out)] = full[take]
    for i in np.flatnonzero(brief):
        own = w.hash[w.at[i] : w.at[i + 1]] * powers(n + 1)[1 : n_words[i] + 1]
        out[at[i]] = mix(own.sum(keepdims=True) + n_words[i : i + 1].astype(np.uint64))[0]
    return out, at


def shared_folder(df: DataFrame) -> str:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there,
    columns can still be pruned, and a lost executor costs nothing that was written."""
    path = f"{shared_folder(df).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The columns that an operator doesn't work on, as one struct.
ROW = "_row"


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns and all others as one struct, so that none of these can clash with a
    name that an operator uses inside."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used] or [F.lit(True).alias("none")]
    return docs.select(*used, F.struct(*others).alias(ROW))


def unpacked(df: DataFrame, columns: list[str], *more: Column, **used: Column) -> DataFrame:
    """The columns as they were, the used ones as given, and more after them."""
    return df.select(*[(used[c] if c in used else F.col(f"{ROW}.`{c}`")).alias(c) for c in columns], *more)


def n_words(text: Column) -> Column:
    """Number of words as an expression; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
