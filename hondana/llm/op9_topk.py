"""Exact top-k inner products by columnar branch and bound.

Queries go to the tasks in blocks of at most ``QUERY_BYTES``, one at a time: a block's partial results are a table before the
next one is read, and its broadcast is destroyed, so neither the driver nor a worker holds more than one. Candidates come in Arrow batches, turned to a vertical layout (a row per
dimension), dimensions in order of
most mass first. It adds up the first ``DIMS`` dimensions for some queries at once; then, for each query,
only such candidates are kept, packed together, whose sum so far plus the product of the remaining norms of query and
candidate (no inner product of the rest can be larger) reaches the k-th best score known; the next dimension block
is added for those alone. Each task returns at most k + 1 rows per query, which one ranking merges.

Every row whose vec_id is divisible is a query, every row but itself its candidate, also others of the same vec_id. Tasks take all rows for candidates; as
the query's own row is one of those with its id and its square, the ranking takes one such off.

Edge cases: vectors that are null or hold null or non-finite components, and rows without vec_id, take no
part; vectors of other lengths count as padded with zeros; equal scores go to the smaller vec_id; rows of one vec_id are
queries of their own, with ranks of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hondana.llm import scratch

K = 10
EVERY = 100
QUERY_BYTES = 64 << 20
#: Queries that a task works on at once.
SOME = 512
DIMS = 16
ROWS = 4096


def whole(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (array<long>, floor of scale times each component) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double"))).alias("v"))


def padded(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, cut or padded with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.cumsum(sizes) - sizes
    for k, (a, n) in enumerate(zip(at, sizes)):
        out[k, : min(n, width)] = flat[a : a + min(n, width)]
    return out


class Best:
    """The k best (score, vec_id) of every query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n

    def least(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.r_[self.scores[q], scores], np.r_[self.ids[q], ids]
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]


def search(best: Best, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, dims: int = DIMS) -> int:
    """Add the candidates ``rows`` to ``best``; the number of products that were left out."""
    return sum(_search(best, at, queries[at : at + SOME], ids, rows, dims) for at in range(0, len(queries), SOME))


def _search(best: Best, offset: int, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, dims: int) -> int:
    mass = np.abs(queries).sum(axis=0, dtype=np.float64) * np.abs(rows).sum(axis=0, dtype=np.float64)
    order = np.argsort(-mass, kind="stable")
    q, x = queries[:, order], np.ascontiguousarray(rows[:, order].T)  # x: one row a dimension
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(x)) < 2**53
    kind = np.float64 if exact else np.int64
    q, x = q.astype(kind), x.astype(kind)
    rest_q = np.sqrt(np.cumsum(q[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1])
    rest_x = np.sqrt(np.cumsum(x[::-1].astype(np.float64) ** 2, axis=0)[::-1])
    width, skipped = len(x), 0
    first = q[:, :dims] @ x[:dims]
    for k in range(len(q)):
        least, some, total = best.least(offset + k), np.arange(len(ids)), first[k]
        for d in range(dims, width, dims):
            if least > -np.inf:
                keep = total + rest_q[k, d] * rest_x[d, some] * (1 + 1e-9) + 1e-6 >= least
                skipped += (len(keep) - int(keep.sum())) * (width - d)
                some, total = some[keep], total[keep]
            if not len(some):
                break
            total = total + q[k, d : d + dims] @ x[d : d + dims, some]
        if least > -np.inf:
            keep = total >= least
            some, total = some[keep], total[keep]
        if len(some):
            best.add(offset + k, total.astype(np.int64), ids[some])
    return skipped


def op9_topk(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of every row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    rows = whole(vectors)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")).orderBy("vec_id", "v")
    schema = "query long, query_id long, copies long, vec_id long, score long, own boolean"
    path, number = scratch.folder(spark, "found"), 0
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, copies, queries in _blocks(asked, block):
        shared = spark.sparkContext.broadcast((ids, copies, queries))

        def task(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            ids, copies, q = shared.value
            best = Best(len(q), k + 1)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    search(best, q, some.column(0).to_numpy(), padded(some.column(1), q.shape[1]))
            of = np.repeat(np.arange(len(q)), [len(x) for x in best.scores])
            found, scores = np.concatenate([*best.ids, np.zeros(0, np.int64)]), np.concatenate([*best.scores, np.zeros(0, np.int64)])
            own = (found == ids[of]) & (scores == (q * q).sum(axis=1)[of])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of + number, ids[of], copies[of], found, scores, own)], ["query", "query_id", "copies", "vec_id", "score", "own"])

        rows.mapInArrow(task, schema).write.mode("append").parquet(path)
        shared.destroy()
        number += len(ids)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", F.col("own").desc())
    ranked = spark.read.schema(schema).parquet(path).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    mine = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    ranked = ranked.withColumn("mine", F.coalesce(mine, F.lit(k + 2))).where("place != mine")
    ranked = ranked.withColumn("rank", F.col("place") - (F.col("place") > F.col("mine")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def _blocks(asked: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """vec_ids, copies and vectors of the queries in order, ``block`` bytes at a time, padded to the longest of their block."""
    held: list = []
    widest = 1

    def packed():
        out = np.zeros((len(held), max([1, *(len(r.v) for r in held)])), np.int64)
        for row, r in zip(out, held):
            row[: len(r.v)] = r.v
        return np.array([r.vec_id for r in held], np.int64), np.array([r.copies for r in held], np.int64), out

    for r in asked.toLocalIterator():
        widest = max(widest, len(r.v))
        if held and 8 * widest * (len(held) + 1) > block:
            yield packed()
            held, widest = [], max(1, len(r.v))
        held.append(r)
    if held:
        yield packed()


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r != c.r),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
