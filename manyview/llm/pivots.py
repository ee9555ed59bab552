"""Approximate nearest neighbours by a permutation index (operator 11), largest inner product first.

A vector is represented by its nearest pivots in order. Inner products become distances by one
more component that gives all vectors the length of the longest; a query has 0 there.

*Index.* Pivots are ``PIVOTS`` distinct vectors of a sample of ``SAMPLE`` rows (the smallest
hashes of their ids), the only rows that reach the driver. Every row is indexed: its
``ORDER`` nearest pivots are stored beside it, and rows are dealt to blocks by hash. In a
block, the inverted file of a pivot holds the pivot's position in every row's order
(``ORDER`` where it is not among them).

*Search.* Query blocks meet all blocks of rows. The footrule distance of a query to all rows
of a block comes from the files of the query's own pivots: the sum of differences of the
positions in both orders, cut at ``ORDER``, differs from minus twice the sum over these of
``ORDER`` less the larger position by a constant. The nearest rows of a block by footrule
(``SHARE`` of its rows, and so many more in small tables that ``LEAST`` times k rows are taken in
all) are reranked by their inner products with the query in double precision, and only
the k best leave the block. A group is one block of rows and one of queries, whatever
is frequent.

Defined results: vectors that are null, zero, hold a null or a non-finite component, or are
not of the most frequent length (the larger of two as frequent) take no part, nor do null
ids; rows of equal id or equal vector are rows of their own, and only the query's own row is
no candidate of it; ties go to the smaller id; with k candidates or fewer all are returned;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query
from .text import staged, table

PIVOTS, SAMPLE = 256, 2048
#: Pivots in a row's order.
ORDER = 128
SHARE, LEAST = 0.10, 20
#: Rows of a block of the index, and of a block of queries.
ROWS, QUERIES = 4096, 512
NEAREST = 20
QUERY_EVERY = 20


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows that take part: (row, id, vec), written once so that ``row`` stays."""
    vec = F.col(vector)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    own = rows.filter(F.col(key).isNotNull() & vec.isNotNull()).filter(finite & some)
    own = staged(own.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), vec.alias("vec")))
    usual = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.filter(F.size("vec") == (usual["n"] if usual else 0))


def squared(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one more component, all of the longest's length (its square is given)."""
    return np.column_stack((x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))))


def choose_pivots(own: DataFrame, longest: float, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    taken = own.orderBy(F.xxhash64("id"), "row").limit(sample).select("vec").toArrow().column("vec")
    distinct = dict.fromkeys(map(tuple, stack(taken))) if len(taken) else {}
    return lifted(np.array(list(distinct))[:pivots], longest) if distinct else np.zeros((0, 1))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first (all vectors of one length)."""
    near = x @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :order].astype(np.int16)


def indexed(own: DataFrame, pivots: np.ndarray, longest: float, order: int = ORDER, queries: bool = False) -> DataFrame:
    """``own`` with each row's pivots in order; as queries, the further component is 0."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = stack(b.column("vec"))
                near = nearest_pivots(np.column_stack((x, np.zeros(len(x)))) if queries else lifted(x, longest), pivots, order)
                yield b.append_column("pivots", pa.array([r.tobytes() for r in near], pa.binary()))

    kind = own.schema["vec"].dataType.simpleString()
    return own.mapInArrow(run, f"row long, id {own.schema['id'].dataType.simpleString()}, vec {kind}, pivots binary")


def orders(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("pivots").to_pylist()), np.int16).reshape(t.num_rows, -1)


def search_block(rows: pa.Table, queries: pa.Table, n_pivots: int, share: float, k: int) -> dict[str, np.ndarray]:
    """The k best rows of a block, sorted by id, for every query of a block."""
    near, asked = orders(rows), orders(queries)
    n, order = near.shape
    files = np.full((n_pivots, n), order, np.int16)
    files[near, np.arange(n)[:, None]] = np.arange(order, dtype=np.int16)
    by_part = np.ascontiguousarray(stack(rows.column("vec")).T)
    q, own = stack(queries.column("vec")), queries.column("row").to_numpy()
    row = rows.column("row").to_numpy()
    where = {int(r): i for i, r in enumerate(row)}
    taken = min(n, int(np.ceil(share * n)) + k)
    place = np.arange(order, dtype=np.int16)[:, None]
    out = {"query": [], "at": [], "score": []}
    for i in range(len(q)):
        # Less is nearer; equal distances go by id.
        far = np.maximum(files[asked[i]], place).sum(0, dtype=np.int32).astype(np.int64) * n + np.arange(n)
        if int(own[i]) in where:
            far[where[int(own[i])]] = np.iinfo(np.int64).max
        best = np.argpartition(far, taken - 1)[:taken]
        best.sort()
        best = best[row[best] != own[i]]
        # Products are added component by component, so that equal vectors have equal scores.
        score = (by_part[:, best] * q[i][:, None]).sum(0)
        top = np.argsort(-score, kind="stable")[:k]
        out["query"].append(np.full(len(top), i))
        out["at"].append(best[top])
        out["score"].append(score[top])
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}


def nearest(
    rows: DataFrame, is_query: Column, key: str, vector: str, k: int = NEAREST, share: float = SHARE, least: int = LEAST,
    block: int = ROWS, query_block: int = QUERIES, n_pivots: int = PIVOTS, order: int = ORDER,
) -> DataFrame:
    """The k rows of largest inner product found for each query: (query_row, query_id, rank, row, id, score).

    ``is_query`` is a condition on the column ``id``, the key; null is false.
    """
    own = usable(rows, key, vector)
    is_query = F.coalesce(is_query, F.lit(False))
    sums = own.agg(F.count(F.lit(1)).alias("n"), F.max(squared(F.col("vec"))).alias("longest"), F.sum(is_query.cast("long")).alias("asked")).first()
    n, longest, asked = sums["n"], sums["longest"] or 0.0, sums["asked"] or 0
    ident = own.schema["id"].dataType.simpleString()
    pivots = choose_pivots(own, longest, n_pivots)
    order = min(order, len(pivots))
    share = min(1.0, max(share, least * k / max(n, 1)))
    row_blocks, query_blocks = -(-n // block) or 1, -(-asked // query_block) or 1
    deal = lambda salt, blocks: F.pmod(F.xxhash64(F.lit(salt), F.col("row")), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = indexed(own, pivots, longest, order).withColumn("rb", deal("row", row_blocks)).withColumn("qb", every(query_blocks))
    queries = indexed(own.filter(is_query), pivots, longest, order, queries=True)
    right = queries.withColumn("qb", deal("query", query_blocks)).withColumn("rb", every(row_blocks))
    schema = f"query_row long, query_id {ident}, row long, id {ident}, score double"

    def run(r: pa.Table, q: pa.Table) -> pa.Table:
        if not (r.num_rows and q.num_rows):
            return pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], q.schema.field("id").type), "row": pa.array([], pa.int64()),
                             "id": pa.array([], r.schema.field("id").type), "score": pa.array([], pa.float64())})
        r = r.sort_by([("id", "ascending"), ("row", "ascending")])
        found = search_block(r, q, len(pivots), share, k)
        of, at = pa.array(found["query"]), pa.array(found["at"])
        return pa.table({"query_row": q.column("row").take(of), "query_id": q.column("id").take(of),
                         "row": r.column("row").take(at), "id": r.column("id").take(at), "score": pa.array(found["score"])})

    met = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(run, schema)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


@query("op11_nearest_neighbours")
def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every one whose id is divisible by 20."""
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_EVERY == 0, "vec_id", "embedding")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
