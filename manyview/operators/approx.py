"""Approximate nearest neighbours: randomised buckets, several probes, exact distances.

Each of a few tables cuts space by directions between random pairs of sample vectors, at the
median of the sample's projections. The number of cuts follows from the number of rows,
so that buckets keep their size at any scale. A query looks into its own bucket and into those
behind the cuts it is nearest to (least total distance to the cuts first); how many is set by
``checks``, the rows to be compared in each table. Everything found is compared by exact
distances, ties go to the smaller id, and only the k best of a bucket leave it.

Rows meet by (table, bucket) inside pairs of blocks of ``CELL_ROWS`` rows, whatever the size of a
bucket (copies are collapsed before). Every vector is written once, instead of once a table and probe,
and read again from there; every block of queries reads every block of rows, of which it compares only the rows
in its buckets. What reaches the driver is the sample of ``SAMPLE`` rows. A query gives a list for each part of the corpus.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import knn
from .knn import Search, _Nearest, _sample, _schema

SAMPLE = 4096
CELL_ROWS = 4096
#: Nearest cuts among which the further buckets of a query are chosen.
FLIPS = 6


def bucketed(tables: int = 8, bucket: int = 64, checks: int = 512, seed: int = 7) -> Search:
    """A search for ``knn.knn_join`` and ``knn.self_knn``."""

    def search(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
        head = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
        if not head["n"]:
            return q.sparkSession.createDataFrame([], _schema(q, c))
        cuts = int(np.ceil(np.log2(max(1.0, head["n"] / bucket))))
        planes = _planes(_sample(c, SAMPLE), tables, cuts, seed)
        probes = min(max(1, -(-checks // bucket)), 2 ** min(cuts, FLIPS))
        return _search(q, c, head["n"], head["dim"], k, planes, probes)

    return search


def _planes(sample: np.ndarray, tables: int, cuts: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and places of the cuts of every table."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        ends = sample[rng.integers(0, len(sample), (2, cuts))]
        way = ends[0] - ends[1] + 1e-9 * rng.normal(size=(cuts, sample.shape[1]))
        way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-300)
        out.append((way, np.median(sample @ way.T, axis=0)))
    return out


def codes(x: np.ndarray, plane: tuple[np.ndarray, np.ndarray], probes: int) -> np.ndarray:
    """(row, probe) bucket numbers: the own bucket, then those behind the nearest cuts."""
    way, place = plane
    off = x @ way.T - place
    own = (off > 0) @ (1 << np.arange(len(place), dtype=np.int64))
    if probes == 1 or not len(place):
        return own[:, None]
    few = min(FLIPS, len(place))
    nearest = np.argsort(np.abs(off), axis=1, kind="stable")[:, :few]
    gap = np.take_along_axis(off, nearest, 1) ** 2
    sets = np.array([[i in chosen for i in range(few)] for n in range(few + 1) for chosen in combinations(range(few), n)], dtype=np.int64)
    best = np.argsort(gap @ sets.T, axis=1, kind="stable")[:, :probes]
    flip = (1 << nearest) @ sets.T
    return own[:, None] ^ np.take_along_axis(flip, best, 1)


class _InBuckets(_Nearest):
    """The k nearest found for a block of queries among the rows in their buckets."""

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int, planes: list, probes: int):
        super().__init__(ids, x, k)
        self.planes, self.asked = planes, [codes(x, plane, probes) for plane in planes]

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        filed = []
        for plane in self.planes:
            code = codes(y, plane, 1)[:, 0]
            order = np.argsort(code, kind="stable")
            held, first = np.unique(code[order], return_index=True)
            filed.append((order, held, first, np.diff(np.append(first, len(y)))))
        for s in range(0, len(self.x), knn.QUERY_STEP):
            part = len(self.x[s : s + knn.QUERY_STEP])
            # A row met in several tables counts once.
            met = np.zeros(part * len(y), dtype=bool)
            for asked, (order, held, first, size) in zip(self.asked, filed, strict=True):
                code = asked[s : s + part]
                at = np.minimum(np.searchsorted(held, code.ravel()), len(held) - 1)
                hit = np.flatnonzero(held[at] == code.ravel())
                at = at[hit]
                within = np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                met[np.repeat(hit // code.shape[1] * len(y), size[at]) + order[np.repeat(first[at], size[at]) + within]] = True
            row, col = np.divmod(np.flatnonzero(met), len(y))
            self.measure(row + s, col, ids, y)


def _search(q: DataFrame, c: DataFrame, n: int, dim: int, k: int, planes: list, probes: int) -> DataFrame:
    one = lambda df, rows: cut(knn.in_blocks(df, np.zeros((1, dim)), np.array([rows]), CELL_ROWS))
    held = one(c, n)
    asked = held if q is c else one(q, q.count())
    return knn.meet_blocks(asked, held, None, (q, c), n, dim, k, partial(_InBuckets, planes=planes, probes=probes), _schema(q, c))
